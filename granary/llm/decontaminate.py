"""Benchmark decontamination by template windows.

Texts become sequences of tokens (words and numbers). Besides its tokens in lower case, a text has a
canonical form in which numbers, units after numbers, and names (capitalised words inside a sentence) are
typed placeholders. Windows of `WINDOW` tokens are hashed and joined to those of the benchmark: plain
windows, and canonical windows that hold both a placeholder and a literal word. Each canonical match names a
diagonal, on which text and item are then compared token by token: the windows that agree must together hold
enough literal words, and equal benchmark values must stand where the document has equal values, as in a
question asked anew with other numbers and names. Items that differ in the values of their placeholders only
are one class, matched and reported as one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._common import fresh, materialise, table

#: Tokens in a window; literals that a canonical match holds, or all of an item that has fewer.
WINDOW, MIN_LITERALS = 8, 5
#: A document is contaminated by an item if it holds this many of its tokens, or this share of them.
MIN_TOKENS, MIN_SHARE = 13, 0.5
#: Benchmark windows up to this many are broadcast, at about 100 bytes each; more are joined by shuffling.
BROADCAST_WINDOWS = 500_000
_MARK = "\u0001"
_TOKEN = r"\d+(?:[.,]\d+)*|\x01?[\p{L}\p{M}]+"
_NAME = r"(?<=[\p{Ll}\d,]\s)(?=\p{Lu})"
# Unit words that become placeholders after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs day days hour hours minute minutes second seconds week weeks month months year years meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degrees watt watts volt volts".split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(" "))


def tokens(text: Column) -> Column:
    """Words and numbers of a text in lower case; null is empty."""
    return F.regexp_extract_all(F.lower(_clean(text)), F.lit(_TOKEN), F.lit(0))


def marked(text: Column) -> Column:
    """The same tokens with their case, names with a mark before them."""
    return F.regexp_extract_all(F.regexp_replace(_clean(text), _NAME, _MARK), F.lit(_TOKEN), F.lit(0))


def canonical(parts: Column) -> Column:
    """Typed placeholders for numbers, units and names, other tokens in lower case."""

    def of(w: Column, i: Column) -> Column:
        digit = lambda c: (c >= "0") & (c < ":")  # noqa: E731  the bytes of tokens that start with a digit
        before = F.when(i > 0, F.get(parts, i - 1))
        return F.when(digit(w), NUMBER).when(F.lower(w).isin(UNITS) & F.coalesce(digit(before), F.lit(False)), UNIT).when(F.startswith(w, F.lit(_MARK)), NAME).otherwise(F.lower(w))

    return F.transform(parts, of)


def _hashes(parts: Column, size: int) -> Column:
    h = F.transform(parts, lambda w, i: F.xxhash64(w, *(F.get(parts, i + j) for j in range(1, size))))
    return F.slice(h, 1, F.greatest(F.size(parts) - (size - 1), F.lit(0)))


def _slots(c: Column) -> Column:
    return c.isin(NUMBER, UNIT, NAME)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _plain_windows(parts: Column, size: int) -> Column:
    """array<struct<size, at, hash>> of all windows of `size` tokens."""
    return F.transform(_hashes(parts, size), lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("at"), h.alias("hash")))


def _template_windows(parts: Column, size: int) -> Column:
    """The same of the canonical windows with a placeholder and a literal.

    Windows of placeholders alone need not be hashed: a match needs literals, and other windows of its diagonal have them.
    """
    last = F.size(parts) - size
    slots = F.filter(F.transform(parts, lambda w, i: F.when(_slots(w), i)), lambda i: i.isNotNull())
    spans = F.transform(slots, lambda i: F.when((last >= 0) & (i <= last + (size - 1)), F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, last))).otherwise(F.array().cast("array<int>")))
    some = F.filter(F.array_distinct(F.flatten(spans)), lambda i: ~_all([_slots(F.get(parts, i + j)) for j in range(size)]))
    return F.transform(some, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(F.lit("template"), *(F.get(parts, i + j) for j in range(size))).alias("hash")))


def _has_slots(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"\d|{_NAME}")


def _exploded(rows: DataFrame, keep: list[str], windows: list[Column], template: bool) -> DataFrame:
    both = rows.select(*keep, F.explode(windows[0] if len(windows) == 1 else F.concat(*windows)).alias("x"))
    return both.select(*keep, "x.size", "x.at", "x.hash", F.lit(template).alias("template"))


def _plain(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(row columns but text, size, at, hash, template) for the plain windows of rows with a column text, all sizes in one scan."""
    keep = [c for c in rows.columns if c != "text"]
    # arrays are columns of their own, or each place that refers to them would be made again
    return _exploded(rows.select(*keep, tokens(F.col("text")).alias("w")), keep, [_plain_windows(F.col("w"), s) for s in sizes], False)


def _form(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for the canonical windows."""
    keep = [c for c in rows.columns if c != "text"]
    form = rows.where(_has_slots(F.col("text"))).select(*keep, marked(F.col("text")).alias("w")).select(*keep, canonical(F.col("w")).alias("c"))
    return _exploded(form, keep, [_template_windows(F.col("c"), s) for s in sizes], True)


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, text, item_tokens, class, class_id): one row per different item and text that has tokens.

    Items are in one class if their canonical forms are equal and the same of their places hold equal values;
    class_id is the class's smallest item_id. A match with one of a class is a match with all.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).distinct()
    items = items.withColumn("item_tokens", F.size(tokens(F.col("text")))).where("item_tokens > 0").withColumn("w", marked(F.col("text")))
    low = F.transform("w", lambda w: F.lower(w))
    items = items.withColumn("low", low).withColumn("c", canonical(F.col("w")))
    # a placeholder is told apart by the first place of its value
    shape = F.transform("c", lambda c, i: F.when(_slots(c), F.concat(c, F.array_position("low", F.get("low", i)).cast("string"))).otherwise(c))
    items = items.select("item_id", "text", "item_tokens", F.md5(F.array_join(shape, " ")).alias("class"))
    ids = items.groupBy("class").agg(F.min("item_id").alias("class_id")).withColumnRenamed("class", "of")
    return items.join(ids, F.col("class") == F.col("of")).drop("of")


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, matched_tokens, item_tokens, reparameterised): the items that documents hold, by item_classes' class_id.

    An item shorter than a window is matched whole, by windows of its own length; an item without tokens
    matches nothing. Null and empty texts match nothing; null ids are reported as such. Rows that repeat an
    id are judged each by its own text and reported once, by the largest match. reparameterised tells that some
    of the matched tokens were found by template only. No rows on either side give no rows. Other columns are not
    looked at, whatever their names.
    """
    items = materialise(spark, item_classes(benchmark, item_col, item_text_col), "items")
    # one text of each class stands for it where values do not matter
    models = items.groupBy("class").agg(F.min("class_id").alias("item_id"), F.min("text").alias("text"), F.min("item_tokens").alias("item_tokens"))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"))
    # at most WINDOW numbers
    sizes = sorted(r[0] for r in items.select(F.least("item_tokens", F.lit(WINDOW)).alias("n")).distinct().collect()) or [WINDOW]
    whole = F.col("size") == F.least(F.col("item_tokens"), F.lit(WINDOW))
    theirs = ["class", "item_tokens"]
    there = _plain(items.select(*theirs, "text"), sizes).where(whole).distinct().union(_form(models.select(*theirs, "text"), sizes).where(whole))
    there = there.select(*theirs, F.col("size").alias("item_size"), F.col("at").alias("item_at"), F.col("hash").alias("item_hash"), F.col("template").alias("item_template"))
    there = materialise(spark, there, "windows")
    if there.count() <= BROADCAST_WINDOWS:
        there = F.broadcast(there)
    same = (F.col("hash") == F.col("item_hash")) & (F.col("size") == F.col("item_size")) & (F.col("template") == F.col("item_template"))
    hits = _plain(source, sizes).union(_form(source, sizes)).join(there, same)
    hits = hits.select("id", "text_hash", *theirs, "size", "item_at", F.when(F.col("template"), F.col("at") - F.col("item_at")).alias("diagonal"))
    hits = materialise(spark, hits, "matches")
    key = ["id", "text_hash", "class"]
    cover = lambda of: F.array_distinct(F.flatten(F.transform(of, lambda at: F.sequence(at, at + F.col("size") - 1))))
    plain = hits.where("diagonal is null").groupBy(*key, "size").agg(F.collect_set("item_at").alias("at")).select(*key, cover("at").alias("places"), F.lit(False).alias("template"))
    # a table of its own, whose size is known when the join below is planned
    diagonals = materialise(spark, hits.where("diagonal is not null").select(*key, "size", "diagonal").distinct(), "diagonals")
    agreed = _consistent(diagonals, source, models).groupBy(*key, "size").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("at"))
    agreed = agreed.select(*key, cover("at").alias("places"), F.lit(True).alias("template"))
    both = plain.union(agreed).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.coalesce(F.max(F.when(~F.col("template"), F.size("places"))), F.lit(0)).alias("plain"))
    names = models.select(F.col("class").alias("of"), "item_id", "item_tokens")
    both = both.join(names, F.col("class") == F.col("of")).select("id", "item_id", "item_tokens", F.size("places").alias("matched_tokens"), (F.size("places") > F.col("plain")).alias("reparameterised"))
    both = both.where((F.col("matched_tokens") >= MIN_TOKENS) | (F.col("matched_tokens") >= MIN_SHARE * F.col("item_tokens")))
    best = both.groupBy("id", "item_id").agg(F.max(F.struct("matched_tokens", ~F.col("reparameterised"), "item_tokens", "reparameterised")).alias("x"))
    return best.select("id", "item_id", "x.matched_tokens", "x.item_tokens", "x.reparameterised")


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: not merged into later expressions, whose lambdas would compute them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _consistent(diagonals: DataFrame, source: DataFrame, models: DataFrame) -> DataFrame:
    """The diagonals (id, text_hash, class, size, diagonal) that hold up, with the item's places of their windows.

    All windows of the diagonal that agree in canonical form count, hashed or not. Together they must hold
    enough literals, and a benchmark value must have one document value wherever it stands; several may have
    the same. Where the windows do not all go together, as when other numbers follow a copy, those that hold
    enough literals on their own must. A diagonal alone must cover as much of the item as a match has to, for
    short templates recur by chance.
    """
    texts = source.where(_has_slots(F.col("text"))).select(F.col("id").alias("of"), F.col("text_hash").alias("hash_of"), "text")
    some = diagonals.select(F.col("id").alias("want"), F.col("text_hash").alias("hash_want")).distinct()
    texts = texts.join(some, F.col("of").eqNullSafe(F.col("want")) & (F.col("hash_of") == F.col("hash_want")), "left_semi").select("of", "hash_of", marked(F.col("text")).alias("theirs"))
    wanted = models.select(F.col("class").alias("class_of"), marked(F.col("text")).alias("ours"))
    both = diagonals.join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash_of"))).join(wanted, F.col("class") == F.col("class_of"))
    n, size, shift = F.size("ours"), F.col("size"), F.col("diagonal").cast("int")
    # the part of the text that the item would cover, after the token before it, which tells whether the first is a unit
    part = F.transform(F.sequence(F.lit(-1), n - 1), lambda i: F.coalesce(F.when(i + shift >= 0, F.get("theirs", i + shift)), F.lit("")))
    both = _computed(both, kinds=canonical(F.col("ours")), part=part)
    both = _computed(both.drop("theirs"), there=F.slice(canonical(F.col("part")), 2, n))
    kinds = F.col("kinds")
    both = _computed(both, same=F.array_join(F.zip_with("kinds", "there", lambda a, b: F.when(a == b, "=").otherwise("-")), ""))
    starts = F.when(n >= size, F.filter(F.sequence(F.lit(0), n - size), lambda a: ~F.contains(F.substring(F.col("same"), a + 1, size), F.lit("-")))).otherwise(F.array().cast("array<int>"))
    both = _computed(both, windows=starts)
    literals = lambda c: F.size(F.filter(c, lambda w: ~_slots(w)))
    both = _computed(both, own=F.filter("windows", lambda a: literals(F.slice(kinds, a + 1, size)) >= F.least(F.lit(MIN_LITERALS), size - 1)))
    places = lambda of: F.array_distinct(F.flatten(F.transform(of, lambda a: F.sequence(a, a + size - 1))))
    both = _computed(both, all_places=places("windows"), own_places=places("own"))

    def one_valued(places: str) -> Column:
        at = F.filter(places, lambda i: _slots(F.get(kinds, i)))
        ours = F.transform(at, lambda i: F.struct(F.get(kinds, i).alias("kind"), F.lower(F.get("ours", i)).alias("a")))
        pairs = F.transform(at, lambda i: F.struct(F.get(kinds, i).alias("kind"), F.lower(F.get("ours", i)).alias("a"), F.lower(F.get("part", i + 1)).alias("b")))
        return F.size(F.array_distinct(ours)) == F.size(F.array_distinct(pairs))

    enough = literals(F.transform("all_places", lambda i: F.get(kinds, i))) >= F.greatest(F.least(F.lit(MIN_LITERALS), literals(kinds)), F.lit(1))
    covers = lambda places: (F.size(places) >= MIN_TOKENS) | (F.size(places) >= MIN_SHARE * n)
    held = F.when(enough & one_valued("all_places"), F.when(covers("all_places"), F.col("windows"))).when((F.size("own") > 0) & covers("own_places") & one_valued("own_places"), F.col("own"))
    return _computed(both, held=held).select("id", "text_hash", "class", "size", F.col("held").alias("windows")).where("windows is not null").distinct()


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, columns unchanged, whatever their names.

    Rows that repeat an id go together. Null and empty texts stay. Rows without an id stay only if no row
    without an id holds an item. An empty benchmark keeps all.
    """
    gone_id = fresh(docs.columns, "gone")
    gone = find(spark, docs, benchmark, id_col, text_col).select(F.col("id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of `benchmark` items that each row of `documents` holds."""
    found = find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("matched_tokens").cast("long"), F.col("item_tokens").cast("long"), "reparameterised")
