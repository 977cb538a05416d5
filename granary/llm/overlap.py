"""Near-duplicates by SimHash with an exact check, and an exact search for what fingerprints miss: every pair of texts whose
shingle sets have SIMILARITY or above is linked, no other.

A document is the set of its shingles' 64-bit hashes. Sets x and y whose Jaccard similarity is at least 4/5
have at least 4/5 of the larger in common; so, in any order of the hashes, the first n - ceil(4n/5) + l of
each have l in common. In the order of the hashes themselves, sets too few of whose first hashes occur in
others are left out. For the others:

* the texts that simhash.linked puts together, with its own shingles and radius, are compared in full; the
  links that pass make families;
* fingerprints miss pairs. Hashes are ordered from rare to common; sets that share one of the first
  n - ceil(4n/5) + 1 are put together, and so on along chains. What so comes together within one family
  needs nothing more, all else is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import simhash
from granary.llm._common import discard, fresh, materialise
from granary.llm._components import HUBS, components

#: The least similarity, as a fraction. What is put together is compared in blocks of so many hashes, about.
SIMILARITY, BLOCK_HASHES = (4, 5), 1 << 20
#: Words of a fingerprint's shingles, as in op1_simhash.
PRINT_NGRAM = 4


def shingle_set(text: bytes | None, ngram: int) -> np.ndarray:
    """The different hashes of a text's word shingles in ascending order; words are those of simhash.fingerprint."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - ngram + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[s:e]) for s, e in spans], np.uint64).view(np.int64))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """(id, text_hash, k0, k1, f0, hashes): k0 and k1 are equal for equal sets only; f0 is the text's fingerprint as in op1_simhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(2).to_pylist()
                sets = [shingle_set(t, ngram) for t in texts]
                prints = np.array([simhash.fingerprint(t, PRINT_NGRAM, 1)[0] for t in texts], np.uint64).view(np.int64)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
                places = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(keys[:, j])) for j in (0, 1)), pa.array(prints), hashes], names=["id", "text_hash", "k0", "k1", "f0", "hashes"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(text_col).alias("text_hash"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return source.mapInArrow(run, T.StructType([*(T.StructField(x, T.LongType()) for x in ("id", "text_hash", "k0", "k1", "f0")), T.StructField("hashes", T.ArrayType(T.LongType()))]))


def _share(n: Column) -> Column:
    """ceil(SIMILARITY * n)"""
    a, b = SIMILARITY
    return F.floor((n * a + (b - 1)) / b).cast("int")


def _least(n: Column) -> Column:
    """How many hashes the first ones of two sets must share, by the size of the smaller."""
    return F.greatest(F.floor(n / 20).cast("int"), F.lit(1))


def _with(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (h, ...) joined to counts (h, c, ...), which has each h once and c, the number of its rows.

    The at most HUBS hashes with more than a HUBS-th of all rows are joined by broadcast, so that no task gets
    all rows of such a hash; the others are joined by shuffling.
    """
    most = (counts.agg(F.sum("c")).first()[0] or 0) / HUBS
    named = counts.withColumnRenamed("h", "of")
    hot = F.broadcast(named.where(F.col("c") > most))
    same = F.col("h") == F.col("of")
    rest = rows.join(hot, same, "left_anti").join(named.where(F.col("c") <= most), same)
    return rows.join(hot, same).union(rest).drop("of")


def _left(spark: SparkSession, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (row, hashes) of nodes whose first hashes do not rule out that another set has SIMILARITY."""
    n = F.size("hashes")
    first = rows.where("id is not null").select("row", n.alias("n"), F.explode(F.slice("hashes", 1, F.least(n, n - _share(n) + _least(n)))).alias("h"))
    counts = materialise(spark, first.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "first")
    some = _with(first, counts).groupBy("row").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    some = some.where(F.col("c") >= _least(_share(F.col("n")))).join(nodes.select(F.col("row").alias("of")), F.col("row") == F.col("of"), "left_semi")
    some = materialise(spark, some.select(F.col("row").alias("of")), "some")
    return materialise(spark, rows.join(some, F.col("row") == F.col("of"), "left_semi").select("row", "hashes"), "left")


def _candidates(spark: SparkSession, left: DataFrame) -> DataFrame:
    """(node, component) over sets (row, hashes): those with SIMILARITY are in one component, which may hold others as well.

    Nothing that fingerprints decide enters here, so that what they miss is not missed.
    """
    each = left.select("row", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    counts = materialise(spark, each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    shared = _with(each, counts).groupBy("row").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"))
    # hashes that no other set has come first in the order and need no comparison
    many = F.col("n") - _share(F.col("n")) + 1 - (F.col("n") - F.size("s"))
    rare = shared.where(many > 0).select("row", F.explode(F.slice("s", 1, F.least(many, F.size("s")))).alias("x")).select("row", F.col("x.h").alias("h"))
    rare = materialise(spark, rare, "rare")
    least = materialise(spark, rare.groupBy("h").agg(F.min("row").alias("v"), F.count("*").alias("c")).where("c > 1"), "least")
    return components(spark, _with(rare, least).select(F.col("row").alias("u"), "v").where("u <> v"))


def _connect(ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what pairs with SIMILARITY connect; hashes holds the sets one after another."""
    a, b = SIMILARITY
    _, word = np.unique(hashes, return_inverse=True)
    start = np.concatenate(([0], np.cumsum(sizes)))
    seen = np.zeros(int(word.max()) + 1, bool)
    free, rest, size, wave, u, v = np.arange(len(ids)), word, sizes, [], [], []
    while len(free):
        if wave:
            k = wave.pop()
            own = word[start[k] : start[k + 1]]
            seen[own] = True
            common = np.add.reduceat(seen[rest], np.cumsum(size) - size, dtype=np.int64)
            seen[own] = False
            reached = common * (a + b) >= a * (size + sizes[k])
            u.append(ids[free[reached]])
            v.append(np.full(len(u[-1]), ids[root], np.int64))
            wave += free[reached].tolist()
        else:
            root = free[0]
            wave, reached = [root], np.arange(len(free)) == 0
        if reached.any():
            rest, free, size = rest[np.repeat(~reached, size)], free[~reached], size[~reached]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (component, lo, hi, id, hashes) with the same first three, by which they are sorted. One group at a time is held."""

    def links(groups: np.ndarray, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([0], np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1, [len(ids)]))
        at = np.concatenate(([0], np.cumsum(sizes)))
        found = [_connect(ids[s:e], hashes[at[s] : at[e]], sizes[s:e]) for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["u", "v"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = (np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(3)], 1), b.column(3).to_numpy(zero_copy_only=False), b.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), b.column(4).flatten().to_numpy(zero_copy_only=False))
        if held:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        cut = int(np.flatnonzero((now[0] != now[0][-1]).any(1)).max(initial=-1)) + 1
        places = int(now[2][:cut].sum())
        held = (*(x[cut:] for x in now[:3]), now[3][places:])
        if cut:
            yield links(*(x[:cut] for x in now[:3]), now[3][:places])
    if held:
        yield links(*held)


def links(spark: SparkSession, left: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of sets (row, hashes) with SIMILARITY in one of groups (component, row).

    Rows and sets are unique. A group with over BLOCK_HASHES hashes is dealt out as pairs of hashed blocks to as many tasks.
    """
    sized = left.join(groups.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).select("component", "row", "hashes")
    sized = materialise(spark, sized, "sized")
    total = sized.groupBy("component").agg(F.ceil(F.sum(F.size("hashes")) / BLOCK_HASHES).alias("blocks"))
    # few groups are large: they are broadcast, at most one for each BLOCK_HASHES of the input
    large = F.broadcast(total.where("blocks > 1").withColumnRenamed("component", "of"))
    both = sized.join(large, F.col("component") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    dealt = both.select("component", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"), "row", "hashes")
    dealt = dealt.select("component", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "row", "hashes")
    dealt = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(_link_groups, "u long, v long")
    found = materialise(spark, dealt, "links")
    discard(spark, sized)
    return found


def _alike(spark: SparkSession, left: DataFrame, prints: DataFrame) -> DataFrame:
    """(component, row) over the sets of left whose fingerprints (id, f0), chains of simhash's links connect; each with another one at least."""
    near = simhash.linked(spark, prints).select(F.col("component_id").alias("h"), "id")
    near = materialise(spark, near.join(left.select("row"), F.col("id") == F.col("row"), "left_semi").select("h", F.col("id").alias("row")), "near")
    several = materialise(spark, near.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "several")
    return _with(near, several).select(F.col("h").alias("component"), "row")


def _missed(spark: SparkSession, left: DataFrame, families: DataFrame) -> DataFrame:
    """(component, row) of the candidates in left, without components that lie within one of families (node, component)."""
    known = families.select(F.col("node").alias("of"), F.col("component").alias("family"))
    put = _candidates(spark, left).select(F.col("component").alias("h"), F.col("node").alias("row"))
    put = materialise(spark, put.join(known, F.col("row") == F.col("of"), "left").select("h", "row", F.coalesce("family", "row").alias("family")), "put")
    still = put.groupBy("h").agg(F.count("*").alias("c"), F.min("family").alias("first"), F.max("family").alias("last")).where("first < last").select("h", "c")
    return _with(put.select("h", "row"), materialise(spark, still, "still")).select(F.col("h").alias("component"), "row")


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5) -> DataFrame:
    """(id, text_hash, component_id): one row per row of docs; component_id is the smallest id reachable by links, own id included.

    Equal sets become one node first, with the fingerprint of its row of the smallest id. Null texts and texts without words have the empty set, equal to
    itself only. A row with a null id takes the component of its set and connects nothing; it is null if no
    row with an id has that set. Different texts of one id are documents of their own. No rows give no rows.
    """
    rows = materialise(spark, shingle_sets(docs, id_col, text_col, ngram).withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = rows.where("id is not null").groupBy("k0", "k1").agg(F.min(F.struct("id", "row", "f0")).alias("x"))
    nodes = materialise(spark, nodes.select(F.col("k0").alias("n0"), F.col("k1").alias("n1"), "x.id", "x.row", "x.f0"), "nodes")
    left = _left(spark, rows, nodes)
    keys = materialise(spark, rows.select("id", "text_hash", "k0", "k1"), "keys")
    discard(spark, rows)
    alike = links(spark, left, _alike(spark, left, nodes.select(F.col("row").alias("id"), "f0")))
    found = components(spark, alike.union(links(spark, left, _missed(spark, left, components(spark, alike)))))
    discard(spark, left)
    of = nodes.join(found, F.col("row") == F.col("node"), "left").withColumn("component", F.coalesce("component", "row"))
    least = of.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "c")
    of = of.join(least, F.col("component") == F.col("c")).select("n0", "n1", "component_id")
    return keys.join(of, (F.col("k0") == F.col("n0")) & (F.col("k1") == F.col("n1")), "left").select("id", "text_hash", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5) -> DataFrame:
    """Rows of docs, one of each group of near-duplicates: that with the smallest id. Columns unchanged, whatever their names.

    Rows that repeat an id and text are one document and stay or go together; rows without an id stay. Null
    and blank texts are duplicates of each other. No rows give no rows.
    """
    gone_id, gone_text = (fresh(docs.columns, x) for x in ("gone", "gone_text"))
    gone = classes(spark, docs, id_col, text_col, ngram).where("component_id < id").select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_text)).distinct()
    # written, so that Spark knows its size and shuffles the documents only where it is not small
    gone = materialise(spark, gone, "gone")
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col(gone_id)) & (_text_hash(text_col) == F.col(gone_text)), "left_anti")
