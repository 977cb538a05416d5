"""Line deduplication: lines that many documents share go, but for one document's copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._common import SPACES, ascii_lower, fresh, materialise, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys with more than this part of all shared lines are hot; there can be no more than HOT_KEYS of them.
HOT_KEYS = 4096


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, positions): the lines that go, for each document that loses any.

    Lines are exploded with their keys as 128 bits of hash. Documents are counted per key in two steps: the
    first makes each (key, id) one row, dealt out by both, and only counts per key meet after that, already
    summed in each task. The lines are then joined to the shared keys in two ways: to the at most HOT_KEYS
    keys that each hold more than a HOT_KEYS-th of the shared lines by broadcast, so that no task gets all
    lines of such a key, and to the others by shuffling.
    """
    text = F.col(f"`{text_col}`")
    exploded = docs.select(F.col(f"`{id_col}`").alias("id"), _text_hash(text).alias("text_hash"), F.posexplode(split_lines(text)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = exploded.withColumn("key", key).where(F.length("key") >= min_chars)
    lines = lines.select("id", "text_hash", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    lines = materialise(spark := docs.sparkSession, lines, "lines")
    shared = lines.groupBy("k1", "k2", "id").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    shared = shared.where(F.col("n") >= min_docs).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "holder", "n")
    shared = materialise(spark, shared, "shared")
    most = (shared.agg(F.sum("n")).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(shared.where(F.col("n") > most))
    same = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    rest = lines.join(hot, same, "left_anti").join(shared.where(F.col("n") <= most), same)
    gone = lines.join(hot, same).union(rest).where(~F.col("id").eqNullSafe(F.col("holder")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, **limits: int) -> DataFrame:
    """docs with each text's remaining lines joined by line feeds; `counts` names columns for lines before and dropped.

    Null and empty texts have one empty line and become empty. A null id counts as one document, and as the
    smallest. Rows that repeat an id are one document: a line they share counts once, and goes or stays in
    all of them alike. A column of docs that is named like one of `counts` is replaced. No rows give no rows.
    """
    taken = [*docs.columns, *(counts or ())]
    mark, ident, pos, parts = (fresh(taken, x) for x in ("text_hash", "gone_id", "positions", "parts"))
    gone = dropped_lines(docs, id_col, text_col, **limits).select(F.col("id").alias(ident), F.col("text_hash").alias(mark), F.col("positions").alias(pos))
    text = F.col(f"`{text_col}`")
    joined = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (_text_hash(text) == F.col(mark)), "left").withColumn(parts, split_lines(text))
    lines = F.col(parts)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(pos), F.array().cast("array<int>")))
    kept = F.when(F.col(pos).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    replaced = {x.lower() for x in counts or ()}
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in replaced or c == text_col]
    if counts:
        out += [F.size(lines).cast("long").alias(counts[0]), F.coalesce(F.size(F.col(pos)), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = drop_lines(docs, counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, i, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
shared AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.*, shared.k IS NOT NULL AND l.doc_id <> shared.holder AS gone FROM l LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
