"""Secret scans over a ledger of blobs: each distinct content is scanned once per version of each rule.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table in a
folder of the caller's, has a row for each scan of a blob: which rules at which versions ran, and what
they found. A run scans only the blobs, and of those only the rule versions, that the ledger lacks, adds
its rows, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm._common import exists, materialise, shared_dir, table

# The patterns that must be found.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s:,]|-(?!-))*+-----END \1PRIVATE KEY-----)?")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
#: Bits per character that a forge token's characters must have at least; made-up tokens of few characters have less.
MIN_ENTROPY = 3.0


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(w in low for w in ASSIGN_WORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]


def _forge(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in FORGE.finditer(text) if entropy(m[0][4:]) >= MIN_ENTROPY]


def entropy(text: str) -> float:
    """Bits per character, by how often each character stands in the text."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _plain(pattern: re.Pattern) -> Callable[[str], list[tuple[int, int]]]:
    return lambda text: [m.span() for m in pattern.finditer(text)]


#: Rules by name, in the order in which spans that start together are listed: (version, function from text to spans).
RULES: dict[str, tuple[int, Callable[[str], list[tuple[int, int]]]]] = {
    "assign": (1, _assign),
    "access": (1, _access),
    "hex": (1, _plain(HEX)),
    "pem": (2, _plain(PEM)),
    "jwt": (2, _plain(JWT)),
    "forge": (2, _forge),
}
BASE = ("assign", "access", "hex")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("scanned", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])


def address(text: Column) -> Column:
    """SHA-256 of the content; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _scanner(rules: dict):
    run_by = {f"{name}@{version}": (rank, f) for rank, (name, (version, f)) in enumerate(rules.items())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text, todo in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                text, found = text.as_py(), []
                for key in todo:
                    rank, f = run_by[key]
                    found += [{"start": s, "rank": rank, "rule": key, "end": e} for s, e in f(text)]
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("rule", pa.string()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kind)], names=LEDGER.names)

    return scan


def scan_versions(spark: SparkSession, versions: DataFrame, path_col: str, text_col: str, ledger: str | None = None, rules: dict | None = None) -> DataFrame:
    """(path, blob, spans): one row per row of versions, spans being array<struct<start, rank, rule, end>> in order.

    Positions are code points, ends exclusive. Null and empty texts are one blob and find nothing. Rows
    that repeat a path, or lack one, are rows of their own. Without `ledger` a new one in the shared
    folder serves this run alone. A run that fails before its rows are added leaves the ledger as it was,
    and the next run scans the same blobs.
    """
    rules = RULES if rules is None else rules
    wanted = [f"{name}@{version}" for name, (version, _) in rules.items()]
    source = versions.select(F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), address(F.col(f"`{text_col}`")).alias("blob"))
    keys = materialise(spark, source.select("path", "blob"), "versions")
    before = spark.read.schema(LEDGER).parquet(ledger) if ledger and exists(spark, ledger) else None
    todo = keys.groupBy("blob").agg(F.min("path").alias("at")).withColumn("todo", F.array(*map(F.lit, wanted)))
    if before is not None:
        seen = before.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.when(F.col("seen").isNull(), F.col("todo")).otherwise(F.array_except("todo", "seen"))).where(F.size("todo") > 0)
    todo = todo.select(F.col("blob").alias("want"), "at", "todo")
    unseen = source.join(todo, (F.col("blob") == F.col("want")) & F.col("path").eqNullSafe(F.col("at"))).select("blob", "text", "todo")
    fresh = unseen.mapInArrow(_scanner(rules), LEDGER)
    ledger = ledger or shared_dir(spark) + "/ledger"
    fresh.write.mode("append").parquet(ledger)
    # in the ledger a span's rule is name@version; the result has those of this run's versions, by name
    current = F.transform(F.filter("spans", lambda s: s["rule"].isin(wanted)), lambda s: s.withField("rule", F.substring_index(s["rule"], "@", 1)))
    found = spark.read.schema(LEDGER).parquet(ledger).where(F.arrays_overlap("scanned", F.array(*map(F.lit, wanted))))
    found = found.select("blob", current.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return keys.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets for each row of `documents`, over a ledger of its own."""
    found = scan_versions(spark, table(spark, sf_dir, "documents"), "doc_id", "text")
    of = lambda *rules: F.filter("spans", lambda s: s["rule"].isin(*rules))
    return found.select(
        F.col("path").alias("doc_id"),
        *(F.size(of(r)).cast("long").alias(f"n_{r}") for r in BASE),
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
