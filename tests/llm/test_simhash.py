import random

import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import simhash
from granary.llm._components import components


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, near):
    """Smallest reachable id of each row (id, fingerprint)."""
    comp = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if near(f, g) and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def texts():
    r = random.Random(7)
    vocabulary = ["w%d" % k for k in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.choice((3, 20, 120, 400)))] for _ in range(30)]
    out = []
    for words in base:
        for _ in range(4):
            copy = list(words)
            for _ in range(r.choice((0, 1, 2))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    return [*out, "", None, "  \n", "One", "ONE", "é É", "a b c", "x" * 20000, "long " * 30000]


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r["id"]: (r["f0"] & (2**64 - 1), r["component_id"]) for r in simhash.classes(spark, docs).collect()}
    prints = [(i, fingerprint(t)) for i, t in rows]
    comp = brute(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == {i: (f, comp[i]) for i, f in prints}
    assert len(set(comp.values())) < len(rows) - 20


def test_dense_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "SHORT", 2)
    r = random.Random(3)
    centre, far = r.getrandbits(64), r.getrandbits(64)
    prints = list({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for c in [centre] * 150 + [far] * 40})
    rows = list(enumerate(prints))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    for most in (simhash.BROADCAST_CELLS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_CELLS", most)
        edges = simhash.near_links(spark, spark.createDataFrame(signed, "id long, f0 long"), 64, 4, 2, 1)
        got = {i: i for i, _ in rows} | {x["node"]: x["component"] for x in components(spark, edges).collect()}
        assert got == brute(rows, lambda a, b: (a ^ b).bit_count() <= 4)


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r[0]: r[1] for r in components(spark, edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.classes(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b"), (None, "c d e f g"), (4, "a b"), (4, "a b"), (9, None)]
    got = simhash.classes(spark, spark.createDataFrame(rows, schema)).select("id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4), (None, None), (4, 4), (4, 4), (9, 9)], key=str)


@pytest.mark.parametrize("text", [None, b"", b" \n\t", b"a", b"a b c d e f " * 7000])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4, 1) == [fingerprint((text or b"").decode())]
