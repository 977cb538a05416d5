"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from granary.llm import chat, decontaminate, html, licenses, lines, mixing, quality, secrets, simhash, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_warc": warc.op4_warc,
    "op5_secrets": secrets.op5_secrets,
    "op6_html": html.op6_html,
    "op7_chat": chat.op7_chat,
    "op8_licenses": licenses.op8_licenses,
    "op9_mixing": mixing.op9_mixing,
    "op10_lines": lines.op10_lines,
}
ORACLE_SQL = {
    "op2_quality": quality.SQL,
    "op4_warc": warc.SQL,
    "op7_chat": chat.SQL,
    "op8_licenses": licenses.SQL,
    "op9_mixing": mixing.SQL,
    "op10_lines": lines.SQL,
}
