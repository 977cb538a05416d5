"""The operators that are DataFrame functions alone: lines, mixing, licenses, decontamination."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, licenses, lines, mixing

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


# --- lines ---


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda x: ascii_lower(x.strip(SPACE))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    low = lambda d: (d is not None, d or 0)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(holders[key(x)]) < 3 or max(holders[key(x)], key=low) == d]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines(spark):
    r = random.Random(1)
    pool = ["short", "exactly nineteen ch", "exactly twenty chars", "  A Long Line That Is Shared \t", "a long line that is shared", "ünïcödé line of some lengths", "", " "] + [f"line number {k} of a pool of lines" for k in range(20)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "a\n"), (5, rows[5][1]), (5, "A long line that is shared\nown"), (None, "a long line that is shared\nx"), (63, "\n".join(pool * 2000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("positions", F.lit(1)).withColumn("id", F.lit("c"))
    out = lines.drop_lines(df, counts=("n_lines", "n_dropped"))
    assert no_python(out) and {"positions", "id"} <= set(out.columns)
    got = sorted((tuple(x) for x in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=repr)
    assert got == brute_lines(rows)
    assert lines.drop_lines(df).columns == df.columns
    assert lines.drop_lines(df.limit(0)).count() == 0


# --- mixing ---


def brute_mix(rows, epochs=2):
    """Targets by sharing again and again; the queue served one document after another."""
    words = lambda t: len([w for w in "".join(" " if c in SPACE else c for c in t or "").split(" ") if w])
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += words(t)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * size[s]}
        for s in full or open_:
            target[s] = float(epochs * size[s]) if full else share[s]
        open_ -= full or set(open_)
    served = []
    for s in names:
        queue = sorted(((hashlib.md5(f"{'' if d is None else d}:mix".encode()).hexdigest(), d is not None, d or 0, words(t)) for d, x, t in rows if x == s), key=lambda q: q[:4])
        ahead = 0
        for _ in range(epochs):
            for _, has, d, n in queue:
                ahead += n
                served.append((ahead / weight[s], s, d if has else None, n))
    taken, spent = defaultdict(int), 0
    times = sorted({v for v, *_ in served})
    by_time = defaultdict(list)
    for x in served:
        by_time[x[0]].append(x)
    for v in times:
        spent += sum(x[3] for x in by_time[v])
        if spent > total:
            break
        for _, s, d, n in by_time[v]:
            taken[s, d] += n
    return size, target, taken


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "HEX_DIGITS", 1)
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "b", "c", "d", "é", None]) if seed else "only", " ".join(["w"] * r.randrange(0, 60))) for k in range(300)]
    rows = [x for x in rows if x[1] != "b" or x[0] % 9 == 0] + [(1000, "z", None), (1001, "z", "  ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    m = mixing.mix(spark, df)
    size, target, taken = brute_mix(rows)
    got = m.rows.withColumn("taken", m.copies() * F.col("size")).collect()
    assert len(got) == len(rows) and no_python(m.rows)
    sums, largest = defaultdict(int), defaultdict(int)
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == size[x["source"]]
        assert x["taken"] == taken[x["source"], x["id"]] <= 2 * x["size"]
        sums[x["source"]] += x["taken"]
        largest[x["source"]] = max(largest[x["source"]], x["size"])
    for s in size:
        assert abs(sums[s] - target[s]) <= 2 * largest[s]
    out = mixing.take(spark, df)
    assert out.columns == [*df.columns, "copies"]
    assert {(x["source"], x["doc_id"]) for x in out.collect()} == {k for k in ((x["source"], x["id"]) for x in got if x["taken"]) } | {(x["source"], x["id"]) for x in got if not x["size"] and (x["source"], x["id"]) in {(y["source"], y["doc_id"]) for y in out.collect()}}


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(spark, empty).rows.count() == 0 and mixing.take(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (None, None, "")], "doc_id long, source string, text string")
    m = mixing.mix(spark, blank)
    assert {(x["target"], x[1]) for x in m.rows.select("target", m.copies() * F.col("size")).collect()} == {(0.0, 0)}


# --- licenses ---


def test_license_places(spark):
    r = random.Random(9)
    bits = ["MIT", "mit", "License", "LICENSE,", "apache", "general", "public", "license", "of-mit", "é", "mité", "İ", "x"]
    rows = [(k, r.choice([" ", "-", "\n"]).join(r.choice(bits) for _ in range(r.randrange(0, 30)))) for k in range(200)]
    rows += [(200, None), (201, ""), (202, "mit license " * 20000), (None, "mit license"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("w", F.lit(1))
    out = licenses.scan(spark, df)
    assert no_python(out)
    got = sorted(((x["id"], x["n_words"], sorted((p["at"], p["label"]) for p in x["places"])) for x in out.collect()), key=repr)

    def brute(text):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or "")) if w]
        return len(words), sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())

    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_license_votes(spark, monkeypatch):
    templates = {k: licenses.TEMPLATES[k] for k in ("mit-notice", "mit", "bsd-3-clause", "apache-2.0")}
    notice = templates["mit-notice"]
    edited = notice.replace("without limitation", "but not only").replace("free of charge", "entirely free of any charge")
    words = notice.split()
    rows = [(1, "code\n" * 50 + notice + "\nmore code"), (2, edited), (3, " ".join(words[:12])), (4, " ".join(w + " zz" for w in words)), (5, notice + " x " * 500 + notice), (6, None), (7, "(c) me " + templates["mit"].upper()), (8, templates["bsd-3-clause"].replace("copyright holder", "University")), (9, "x " * 9 + templates["apache-2.0"]), (1, "code\n" * 50 + notice + "\nmore code")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (licenses.BROADCAST_SPANS, -1):
        monkeypatch.setattr(licenses, "BROADCAST_SPANS", most)
        got = defaultdict(list)
        out = licenses.votes(spark, df, "doc_id", "text", templates)
        assert no_python(out)
        for x in out.collect():
            got[x["id"]].append((x["template"], x["first"], round(x["share"], 2)))
        assert got[1] == [("mit-notice", 50, 1.0)]
        assert [t for t, *_ in got[2]] == ["mit-notice"] and got[2][0][2] > 0.9
        assert len(got[5]) == 2 and not {3, 4, 6} & got.keys()
        assert sorted(got[7]) == [("mit", 2, 1.0), ("mit-notice", 2, 1.0)] and got[9] == [("apache-2.0", 9, 1.0)]
        assert [t for t, *_ in got[8]] == ["bsd-3-clause"] and 0.95 < got[8][0][2] < 1
    assert licenses.scan(spark, df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fewer than 4 words"):
        licenses.votes(spark, df, "doc_id", "text", {"short": "MIT license"})


# --- decontamination ---


def test_decontamination(spark):
    items = [(1, "Now Tom has 3 red apples and Tom gives Ann 12 of the green ones in the garden near the river."), (2, "the quick brown fox jumps over the lazy dog while nobody in the village looks at it at all"), (3, "five short words are here"), (4, None), (5, "")]
    filler = "some filler words that have nothing to do with any of it stand around the passage to hide it well "
    again = "We know Sue has 7 red apples and Sue gives Bob 40 of the green ones in the garden near the river."
    mixed_up = "We know Sue has 7 red apples and Joe gives Bob 40 of the green ones in the garden near the river."
    docs = [
        (1, filler + items[0][1] + " " + filler),
        (2, filler + again),
        (3, filler + mixed_up),
        (4, filler * 300 + items[1][1].upper()),
        (5, filler + " ".join(items[1][1].split()[:10])),
        (6, filler),
        (7, "there are Five short, words are here indeed"),
        (8, None),
        (9, ""),
        (10, "12 34 56 78 90 12 34 56 78 90 11 22 33"),
        (None, items[1][1]),
        (1, filler + items[0][1] + " " + filler),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("__gone", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.find(spark, df, bench)
    assert no_python(out)
    got = {(x["id"], x["item_id"]): x for x in out.collect()}
    assert got.keys() == {(1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (None, 2)}  # 3 maps one name to two
    assert got[1, 1]["matched_tokens"] == got[1, 1]["item_tokens"] == 21
    assert got[2, 1]["reparameterised"] and not got[1, 1]["reparameterised"]
    clean = decontaminate.drop_contaminated(spark, df.withColumn("gone", F.lit(2)), bench)
    assert clean.columns == [*df.columns, "gone"]
    assert {x["doc_id"] for x in clean.collect()} == {3, 6, 8, 9, 10}
    assert decontaminate.find(spark, df.limit(0), bench).count() == 0 == decontaminate.find(spark, df, bench.limit(0)).count()


def test_decontamination_equals_brute_force(spark):
    """Without placeholders: windows of eight words in common, by sets."""
    r = random.Random(12)
    words = ["w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10] for k in range(100)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(8, 40)))) for k in range(40)]
    docs = []
    for k in range(150):
        text = [r.choice(words) for _ in range(60)]
        if k % 3 == 0:
            item = r.choice(items)[1].split()
            start = r.randrange(len(item))
            text[20:20] = item[start : start + r.randrange(8, 40)]
        docs.append((k, " ".join(text)))
    expected = {}
    for d, t in docs:
        w = t.split()
        there = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, x in items:
            y = x.split()
            held = {i + j for i in range(len(y) - 7) if tuple(y[i : i + 8]) in there for j in range(8)}
            if held and (len(held) >= 13 or 2 * len(held) >= len(y)):
                expected[d, k] = len(held)
    out = decontaminate.find(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["id"], x["item_id"]): x["matched_tokens"] for x in out.collect()} == expected and len(expected) > 20


def test_decontamination_of_dense_numbers(spark):
    """Items in which no window holds five literals, and short ones, asked anew with other numbers."""
    items = [(1, "A train travels 60 miles in 2 hours and 90 miles in 3 hours. How far?"), (2, "What is 17 plus 25"), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (4, "Add 5 and 9 to 14")]
    filler = "some filler words that have nothing to do with any of it stand around the passage "
    docs = [
        (1, filler + "a train travels 45 miles in 4 hours and 75 miles in 5 hours. How far? " + filler),
        (2, filler + "what is 3 plus 8 " + filler),
        (3, filler + "a train travels 45 miles in 4 hours and 45 miles in 5 hours. How far? " + filler),  # one number for two is a copy
        (4, " ".join(str(k * 7) for k in range(1, 40))),
        (5, filler + "add 7 and 8 to 15 " + "16 17 18 " + filler),
        (6, filler + "what is 3 minus 8 " + filler),
    ]
    out = decontaminate.find(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert no_python(out)
    got = {(x["id"], x["item_id"]): x for x in out.collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 1), (5, 4)}
    assert got[1, 1]["matched_tokens"] == 16 and all(x["reparameterised"] for x in got.values())


NAMES = "Anna Bruno Clara Dario Emma Felix Greta Hugo Ida Jonas Karla Leo Mina Nora Oskar Paula".split()
WORDS = [a + b + c for a in "ba do fi gu le mo ra ti ke pu sa ve wo hi ny".split() for b in "r lan st ven x dd mor p ch gn".split() for c in "a en ing o us el y ish er and".split()]


def question(r):
    """A worded problem of random shape as literal words and slots; equal slots stand for equal values."""
    parts, word = [], lambda: r.choice(WORDS)
    for _ in range(r.randrange(2, 5)):
        parts += ["while", ("name", r.randrange(3)), word(), ("number", r.randrange(4)), word(), word(), "for", ("number", r.randrange(4)), r.choice(["dollars", "days", "hours"]), "at the", word()]
    return [*parts, "how", "many", word(), "are", word(), "in the", word()]


def worded(r, parts):
    names, numbers = r.sample(NAMES, 3), r.sample(range(2, 900), 4)
    return " ".join(x if isinstance(x, str) else names[x[1]] if x[0] == "name" else str(numbers[x[1]]) for x in parts)


def test_decontamination_finds_questions_asked_anew(spark):
    """Recall on 600 re-parameterised items, none of which is left of 13 plain tokens, and precision on 600 other questions."""
    r = random.Random(31)
    shapes = [question(r) for _ in range(600)]
    items = [(k, worded(r, p)) for k, p in enumerate(shapes)]
    filler = "text that stands before and after the passage "
    docs = [(k, filler + worded(r, p) + ". " + filler) for k, p in enumerate(shapes)]
    docs += [(1000 + k, filler + worded(r, question(r)) + ". " + filler) for k in range(600)]
    out = decontaminate.find(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x["id"], x["item_id"]) for x in out}
    recall = sum((k, k) in found for k in range(600)) / 600
    assert recall >= 0.9 and all(x["reparameterised"] for x in out if x["id"] == x["item_id"])
    assert sum(d >= 1000 for d, _ in found) <= 6


def test_decontamination_templates_equal_brute_force(spark):
    """Numbers are the only placeholders: windows that agree but for them, one value of the text for each of the item's."""
    r = random.Random(8)
    words = ["w" + x for x in "abcdefghijklmnopqrstuvwxyz"]
    make = lambda n: [str(r.randrange(5)) if r.random() < 0.35 else r.choice(words) for _ in range(n)]
    anew = lambda x: [str(r.randrange(5)) if c.isdigit() and r.random() < 0.3 else c for c in x]
    items = [(k, make(r.randrange(4, 20))) for k in range(60)]
    docs = [(k, [*make(10), *(anew(r.choice(items)[1]) if k % 2 else make(15)), *make(10)]) for k in range(300)]
    form = lambda x: ["#" if c.isdigit() else c for c in x]
    shape = lambda x: tuple(f"#{x.index(c)}" if c.isdigit() else c for c in x)
    first = {}
    for k, x in items:
        first.setdefault(shape(x), k)
    expected = {}
    for d, t in docs:
        for k, x in items:
            n, size, held = len(x), min(8, len(x)), set()
            plain = {i + j for i in range(n - size + 1) if any(t[p : p + size] == x[i : i + size] for p in range(len(t) - size + 1)) for j in range(size)}
            for shift in range(-n, len(t)):
                there = [t[i + shift] if 0 <= i + shift < len(t) else None for i in range(n)]
                kinds = form(x)
                same = [c is not None and form([c])[0] == q for c, q in zip(there, kinds, strict=True)]
                windows = [a for a in range(n - size + 1) if all(same[a : a + size])]
                mixed = [a for a in windows if {"#"} < set(kinds[a : a + size])]
                if not mixed:
                    continue
                cover = lambda ws: {a + j for a in ws for j in range(size)}  # noqa: B023, E731
                literals = lambda at: sum(kinds[i] != "#" for i in at)  # noqa: B023, E731
                one = lambda at: all(len({there[i] for i in at if x[i] == v}) == 1 for v in {x[i] for i in at if kinds[i] == "#"})  # noqa: B023, E731
                own = [a for a in windows if literals(range(a, a + size)) >= min(5, size - 1)]
                part = set()
                if literals(cover(windows)) >= max(1, min(5, literals(range(n)))) and one(cover(windows)):
                    part = cover(windows)
                elif own and one(cover(own)):
                    part = cover(own)
                if len(part) >= 13 or 2 * len(part) >= n:
                    held |= part
            if len(plain | held) >= 13 or 2 * len(plain | held) >= n:
                key = d, first[shape(x)]
                expected[key] = max(expected.get(key, 0), len(plain | held))
    out = decontaminate.find(spark, spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string"))
    assert {(x["id"], x["item_id"]): x["matched_tokens"] for x in out.collect()} == expected and len(expected) > 60


def test_items_of_one_template_are_one_class(spark):
    make = lambda a, b: f"We know that Tom has {a} red apples and gives {b} of the green ones to the boys near the river"
    items = [(k, make(k, k + 1)) for k in range(2, 50)] + [(1, make(7, 7)), (60, make(5, 9)), (None, make(5, 8))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    classes = {x["item_id"]: x["class_id"] for x in decontaminate.item_classes(bench).collect()}
    assert classes == {**{k: 2 for k in range(2, 50)}, 1: 1, 60: 2, None: 2}
    docs = spark.createDataFrame([(1, "x " + make(3, 4)), (2, make(700, 900)), (3, make(8, 8)), (4, None)], "doc_id long, text string")
    got = {(x["id"], x["item_id"]): x["reparameterised"] for x in decontaminate.find(spark, docs, bench).collect()}
    assert got == {(1, 2): False, (2, 2): True, (3, 1): True, (3, 2): False}  # other members hold each of the eights


def test_matches_are_verified_in_their_own_text(spark):
    """Two texts of one id: the one that maps one name to two is not judged by the other."""
    item = "Now Tom has 3 red apples and Tom gives Ann 12 of the green ones in the garden near the river"
    wrong = "We know Sue has 7 red apples and Joe gives Bob 40 of the green ones in the garden near the river"
    other = "an unrelated text about Kim and 4 birds"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for rows in ([(1, wrong)], [(1, wrong), (1, other)], [(1, other), (1, wrong), (1, wrong)]):
        alone = decontaminate.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        assert [x["matched_tokens"] for x in alone] in ([], [13], [14]) and len({tuple(x) for x in alone}) == len(alone)
