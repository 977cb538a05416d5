import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import overlap, simhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(sets):
    """The smallest reachable id of each (id, set)."""
    comp = dict.fromkeys(i for i, _ in sets)
    for i in comp:
        comp[i] = i
    links = [(i, j) for i, a in sets for j, b in sets if i < j and near(a, b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp


def rows():
    r = random.Random(11)
    vocabulary = ["v%d" % k for k in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    out = []
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.choice((6, 30, 80, 250)))]
        for _ in range(4):
            out.append(" ".join(words) + (" " + passage if r.random() < 0.2 else ""))
            for _ in range(r.choice((0, 1, 2, 3, 6))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    r.shuffle(out)
    return list(enumerate([*out, "", None, " ", "one two", "One TWO", out[0]]))


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_stage_finds_every_pair_and_no_other(spark, monkeypatch, block):
    """The pipeline's stage against all pairs at a similarity of 0.8; with small blocks, groups are dealt out."""
    monkeypatch.setattr(overlap, "BLOCK_HASHES", block)
    docs = rows()
    comp = brute([(i, shingles(t)) for i, t in docs])
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {x["doc_id"] for x in kept.collect()} == {i for i, c in comp.items() if i == c}
    assert 40 < len(set(comp.values())) < len(docs) - 40


def test_ids_and_columns(spark):
    text = " ".join("w%d" % k for k in range(100))
    data = [(3, text), (1, text + " more"), (3, "quite another text"), (3, "quite another text"), (None, text), (None, "alone"), (9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("gone", F.lit(1)).withColumn("gone_text", F.lit(1))
    kept = overlap.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([data[1], data[2], data[3], data[4], data[5], data[6]], key=str)
    assert overlap.classes(spark, docs.limit(0)).count() == 0


def bits(a, b):
    one, other = (simhash.fingerprint((t or "").encode(), 4, 1)[0] for t in (a, b))
    return (one ^ other).bit_count()


def test_fingerprints_link_what_they_reach(spark, monkeypatch):
    """Without the exact search, the stage still links the pairs that SimHash puts together and the exact check passes, and no other."""
    monkeypatch.setattr(overlap, "_candidates", lambda spark, left: spark.createDataFrame([], "node long, component long"))
    docs = rows()
    sets = {}
    for i, t in docs:
        sets.setdefault(shingles(t), (i, t))
    alike = {i: {i} for i, _ in sets.values()}
    for i, t in sets.values():
        for j, x in sets.values():
            if alike[i] is not alike[j] and bits(t, x) <= 4:
                alike[i] |= alike[j]
                for k in alike[j]:
                    alike[k] = alike[i]
    comp = {i: i for i, _ in sets.values()}
    changed = True
    while changed:
        changed = False
        for a, (i, _) in sets.items():
            for b, (j, _) in sets.items():
                if comp[j] < comp[i] and alike[i] is alike[j] and near(a, b):
                    comp[i], changed = comp[j], True
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {x["doc_id"] for x in kept.collect()} == {i for i, c in comp.items() if i == c}
    assert len(set(comp.values())) < len(comp) - 10


def test_equal_fingerprints_alone_link_nothing(spark):
    common = "buy it now while the stock lasts " * 60
    docs = [(k, common + " ".join(f"d{k}x{j}" for j in range(25))) for k in range(3)]
    assert bits(docs[0][1], docs[1][1]) <= 4 and not near(shingles(docs[0][1]), shingles(docs[1][1]))
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").count() == 3


def test_only_what_fingerprints_miss_is_searched(spark):
    """Sets 1, 2 and 3, 4 share hashes; that 1 and 2 are of one family is known, and 5 shares nothing."""
    left = [(1, list(range(20))), (2, list(range(19))), (3, list(range(50, 70))), (4, list(range(50, 69))), (5, list(range(90, 99)))]
    left = spark.createDataFrame(left, "row long, hashes array<long>")
    families = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    assert sorted(overlap._missed(spark, left, families).collect()) == [(3, 3), (3, 4)]
