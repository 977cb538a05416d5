"""SimHash near-duplicates: fingerprints, a grid over per-segment bit counts, exact verification, components.

A fingerprint is cut into segments of two bits. The bit counts of the segments (0, 1 or 2 each) are a
point whose Manhattan distance to another never exceeds the Hamming distance of the fingerprints. Bits
are further grouped: if two fingerprints differ in at most `radius` bits, then in one of `groups` groups
their points lie at most radius // groups apart. Each group's lattice is the grid. With reach 0 a
fingerprint enters the cell of its own point; with reach 1 also the cells next to it, so that any two
points up to 2 apart meet in the cell between them. Fingerprints that share a cell are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from granary.llm._common import materialise, table
from granary.llm._components import components

#: Cells of up to SHORT fingerprints are compared by offset for a whole batch at once; cells of over BLOCK are dealt out as pairs of blocks.
SHORT, BLOCK = 24, 2048
#: Dense cells up to this many are broadcast, at about 100 bytes each; more are joined by shuffling.
BROADCAST_CELLS = 200_000


def fingerprint(text: bytes | None, ngram: int, lanes: int) -> list[int]:
    """`lanes` 64-bit words from a hash of each word shingle, repeats included.

    One lane takes XXH64 with seed 42; of more, each pair takes XXH3 of 128 bits with seed 42 + its number.
    Letters A-Z are lower-cased and words end at ASCII white space (bytes.lower and bytes.split do just
    that). Fewer words than ngram make one shingle; none, or a null, gives zero.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return [0] * lanes
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - ngram + 1)
    spans = list(zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, n, 1 << 13):
        shingles = [joined[s:e] for s, e in spans[at : at + (1 << 13)]]
        if lanes == 1:
            ones += _bit_counts(np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], "<u8").view(np.uint8), 64)
        for pair in range(lanes // 2):
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, 42 + pair) for x in shingles]), np.uint8)
            ones[128 * pair : 128 * (pair + 1)] += _bit_counts(h, 128)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()


def _bit_counts(hashes: np.ndarray, width: int) -> np.ndarray:
    """How many of the hashes (bytes, one after another) have each bit set; 255 at a time are added bytewise, eight bytes at once."""
    bits = np.unpackbits(hashes, bitorder="little").view(np.uint64).reshape(-1, width // 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, bits: int = 64) -> DataFrame:
    """(id, f0, f1, ...): each row's fingerprint in lanes of 64 bits, as signed longs."""
    lanes = bits // 64
    names = [f"f{j}" for j in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(t.as_py(), ngram, lanes) for t in b.column(1)]
            cols = [pa.array(np.array([r[j] for r in rows], np.uint64).view(np.int64)) for j in range(lanes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), *(T.StructField(x, T.LongType()) for x in names)]))


def _cells(lanes: int, groups: int, reach: int) -> list:
    """Cell numbers of one fingerprint: the group's number above its packed bit counts, two bits each."""
    width = 64 * lanes // groups
    out = []
    for g in range(groups):
        lane, at = divmod(g * width, 64)
        x = F.shiftrightunsigned(F.col(f"f{lane}"), at).bitwiseAND(F.lit((1 << width) - 1))
        half = F.lit(0x5555555555555555 & ((1 << width) - 1))
        point = x.bitwiseAND(half) + F.shiftrightunsigned(x, 1).bitwiseAND(half) + F.lit(g << width)
        out.append(point)
        for s in range(0, width, 2) if reach else ():
            count = F.shiftrightunsigned(point, s).bitwiseAND(F.lit(3))
            out += [F.when(count < 2, point + F.lit(1 << s)), F.when(count > 0, point - F.lit(1 << s))]
    return out


def _forest(ids: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(root, members) of each set of ids that chains of links within radius connect; sets of one are left out."""
    n = len(ids)
    near = np.zeros((n, n), bool)
    for s in range(0, n, 128):
        near[s : s + 128] = np.bitwise_count(fps[s : s + 128, None, :] ^ fps[None, :, :]).sum(-1, dtype=np.int32) <= radius
    np.fill_diagonal(near, False)
    free, out = near.any(1), []
    for i in np.flatnonzero(free):
        if free[i]:
            free[i] = False
            wave, found = np.array([i]), [np.array([i])]
            while len(wave):
                wave = np.flatnonzero(near[wave].any(0) & free)
                free[wave] = False
                found.append(wave)
            members = ids[np.concatenate(found)]
            out.append((int(members.min()), members))
    return out


def _link_cells(lanes: int, radius: int):
    """Arrow function over rows (cell..., id, f0...) sorted by cell; yields edges that connect what a cell connects.

    At most one run of rows is held at a time, and no run exceeds two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cell: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            first = np.concatenate(([0], change))
            size = np.diff(np.concatenate((first, [len(ids)])))
            number = np.repeat(np.arange(len(first)), size)
            u, v = [], []
            keep = np.flatnonzero(size[number] <= SHORT)
            i_, f_, n_ = ids[keep], fps[keep], number[keep]
            for k in range(1, min(SHORT, int(size.max(initial=1)))):
                same = np.flatnonzero(n_[k:] == n_[:-k])
                if not len(same):
                    break
                same = same[np.bitwise_count(f_[same] ^ f_[same + k]).sum(-1, dtype=np.int32) <= radius]
                u.append(i_[same])
                v.append(i_[same + k])
            for g in np.flatnonzero(size > SHORT):
                s = slice(first[g], first[g] + size[g])
                for root, members in _forest(ids[s], fps[s], radius):
                    u.append(members[members != root])
                    v.append(np.full(len(u[-1]), root, np.int64))
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
            pairs = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, j])) for j in (0, 1)], names=["u", "v"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            k = len(cols) - 1 - lanes
            now = (np.stack(cols[:k], 1), cols[k], np.stack(cols[k + 1 :], 1).view(np.uint64))
            if held:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.flatnonzero((now[0] != now[0][-1]).any(1)).max(initial=-1)) + 1
            held = tuple(x[cut:] for x in now)
            if cut:
                yield edges(*(x[:cut] for x in now))
        if held:
            yield edges(*held)

    return run


def near_links(spark: SparkSession, nodes: DataFrame, bits: int, radius: int, groups: int, reach: int) -> DataFrame:
    """Edges (u, v) whose components are those of all links found among nodes (id, f0, ...), ids and fingerprints unique.

    A cell's links are given as a spanning forest, never as all pairs. Cells are counted first, summed in each
    task; those with over BLOCK fingerprints, no more than there are cells over BLOCK, are dealt out as pairs of
    hashed blocks to as many tasks, so that no task ever holds more than two blocks.
    """
    lanes = bits // 64
    names = [f"f{j}" for j in range(lanes)]
    cells = F.explode(F.array_compact(F.array(*_cells(lanes, groups, reach)))).alias("cell")
    keyed = nodes.select(cells, "id", *names)
    dense = materialise(spark, nodes.select(cells).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("cell").alias("of"), "n"), "dense")
    small = dense.count() <= BROADCAST_CELLS
    many = F.broadcast(dense) if small else dense
    schema = "u long, v long"
    few = keyed.join(many, F.col("cell") == F.col("of"), "left_anti").repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_cells(lanes, radius), schema)
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks)
    dealt = keyed.join(many, F.col("cell") == F.col("of")).select("cell", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"), "id", *names)
    dealt = dealt.select("cell", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "id", *names)
    return few.union(dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(_link_cells(lanes, radius), schema))


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, bits: int = 64, radius: int = 4, groups: int = 2, reach: int = 1) -> DataFrame:
    """(id, f0, ..., component_id): one row per row of docs.

    component_id is the smallest id reachable by links, own id included. Where radius // groups <= 2 * reach
    no link is lost; otherwise a pair within the radius is found if one group of its bits is near enough.
    Equal fingerprints (equal texts among them) become one node before any comparison. Null texts and
    texts without words have fingerprint zero, linked like any other. A row with a null id takes the
    component of its fingerprint and connects nothing; it is null if no row with an id has that
    fingerprint. Rows that repeat an id each get a row. No rows give no rows.
    """
    return linked(spark, materialise(spark, fingerprints(docs, id_col, text_col, ngram, bits), "fingerprints"), bits, radius, groups, reach)


def linked(spark: SparkSession, rows: DataFrame, bits: int = 64, radius: int = 4, groups: int = 2, reach: int = 1) -> DataFrame:
    """(id, f0, ..., component_id): what classes() says, for written rows (id, f0, ...) whose fingerprints are there."""
    names = [f"f{j}" for j in range(bits // 64)]
    nodes = materialise(spark, rows.where("id is not null").groupBy(*names).agg(F.min("id").alias("id")), "nodes")
    found = components(spark, near_links(spark, nodes, bits, radius, groups, reach))
    of = nodes.join(found, F.col("id") == F.col("node"), "left").select(*(F.col(x).alias(f"k{x}") for x in names), F.coalesce("component", "id").alias("component_id"))
    return rows.join(of, [F.col(x) == F.col(f"k{x}") for x in names], "left").select("id", *names, "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of `documents`: four-word shingles, 64 bits, links at four or fewer differing bits."""
    found = classes(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
