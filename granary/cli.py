"""Command line for the HTTP service: -c runs one statement, without it a prompt reads them."""

from __future__ import annotations

import argparse
import json
import re
import sys
import urllib.error
import urllib.request
from collections.abc import Iterable
from typing import TextIO

WIDEST = 80
HELP = "Statements end with ;  \\q quits, \\c clears, \\s shows the schema, \\h this text."
META = {"\\q": "quit", "exit": "quit", "quit": "quit", "\\c": "clear", "clear": "clear", "cls": "clear", "\\h": "help", "help": "help", "?": "help", "\\s": "schema", "schema": "schema"}


def fetch(url: str, body: str | None = None) -> tuple[int, dict]:
    request = urllib.request.Request(url, None if body is None else body.encode(), method="GET" if body is None else "POST")
    try:
        with urllib.request.urlopen(request, timeout=300) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def shown(v: object) -> str:
    text = "∅" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
    text = text.replace("\n", " ").replace("\t", " ")
    return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"


def layout(result: dict) -> str:
    names = [c["name"] for c in result["columns"]]
    rows = [[shown(v) for v in r] for r in result["rows"]]
    widths = [max(len(shown(n)), *(len(r[k]) for r in rows)) if rows else len(shown(n)) for k, n in enumerate(names)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    n = result["rowCount"]
    return "\n".join([line(map(shown, names)), "-+-".join("-" * w for w in widths), *map(line, rows), f"({n} {'row' if n == 1 else 'rows'} in {result['elapsedMs']} ms)"])


def run_query(url: str, sql: str, out: TextIO, err: TextIO) -> int:
    try:
        status, body = fetch(f"{url}/query", sql)
    except OSError as e:
        print(f"cannot reach {url}: {e}", file=err)
        return 1
    if status != 200:
        print(f"error: {body.get('error', status)}", file=err)
        return 1
    print(layout(body), file=out)
    return 0


_PARTS = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|;|['"]|/\*|[^;'"/-]+|.""", re.S)


def split_statement(buffer: str) -> tuple[str | None, str]:
    """The first statement of the buffer, if its semicolon is there, and what follows; those in quotes and comments don't count."""
    for m in _PARTS.finditer(buffer):
        if m[0] == ";":
            return buffer[: m.start()].strip(), buffer[m.end() :]
        if m[0] in ("'", '"', "/*"):  # not closed yet
            break
    return None, buffer


def repl(url: str, lines: Iterable[str], out: TextIO, err: TextIO) -> int:
    buffer = ""
    for line in lines:
        command = META.get(line.strip().rstrip(";").lower()) if not buffer.strip() else None
        if command == "quit":
            return 0
        if command == "clear":
            print("\033[2J\033[H", end="", file=out)
        elif command == "help":
            print(HELP, file=out)
        elif command == "schema":
            try:
                for c in fetch(f"{url}/schema")[1]["columns"]:
                    print(f"{c['name']} {c['type']}{'' if c['nullable'] else ' not null'}", file=out)
            except OSError as e:
                print(f"cannot reach {url}: {e}", file=err)
        else:
            buffer += line if line.endswith("\n") else line + "\n"
            while (found := split_statement(buffer))[0] is not None:
                statement, buffer = found
                if statement:
                    run_query(url, statement, out, err)
                buffer = buffer if buffer.strip() else ""
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="granary.cli", description="Query a granary server.")
    p.add_argument("--url", default="http://127.0.0.1:8080")
    p.add_argument("-c", dest="sql", help="run one statement and leave")
    args = p.parse_args(argv)
    if args.sql is not None:
        return run_query(args.url, args.sql, sys.stdout, sys.stderr)
    if sys.stdin.isatty():
        print(HELP)
    return repl(args.url, sys.stdin, sys.stdout, sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
