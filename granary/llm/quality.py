"""Quality rules: counts per document and divergence of its histograms from language references.

Two histograms are compared with each language's reference by the Jensen-Shannon distance (base 2, so
between 0 and 1): the classes of the characters in words, and the frequencies of the language's common
words with all others as one bin. A document takes the nearest reference. Distances of short texts are
noise, so each comparison has a least length below which it rejects nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm._common import fresh, table

# The commonest words of English with their counts in the Brown corpus of 1,014,312 words (Kucera and
# Francis, 1967), and of Spanish with their frequencies per million in the CREA corpus (Real Academia Espanola).
BROWN = {"the": 69971, "of": 36411, "and": 28852, "to": 26149, "a": 23237, "in": 21341, "that": 10595, "is": 10099, "was": 9816, "he": 9543, "for": 9489, "it": 8756, "with": 7289, "as": 7250, "his": 6997, "on": 6742, "be": 6377, "at": 5378, "by": 5305, "i": 5173}
CREA = {"de": 65546, "la": 41149, "que": 30689, "el": 29953, "en": 27755, "y": 27401, "a": 21375, "los": 17165, "se": 13257, "del": 12174, "las": 11056, "un": 10880, "por": 10238, "con": 9712, "no": 9606, "una": 8833, "su": 7234, "para": 6962, "es": 6684, "al": 6234}
# The commonest words of French and German in the order of the Leipzig word lists. Their frequencies
# follow from the order by the rule of Zipf and Mandelbrot, 0.1 / (rank + 2.7).
FRENCH = "de la le et les des en un du une que est pour qui dans a par plus pas au".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
COMMON = {
    "en": {w: n / 1014312 for w, n in BROWN.items()},
    "fr": {w: 0.1 / (r + 2.7) for r, w in enumerate(FRENCH, 1)},
    "de": {w: 0.1 / (r + 2.7) for r, w in enumerate(GERMAN, 1)},
    "es": {w: n / 1e6 for w, n in CREA.items()},
}
# The share of letters beyond ASCII among the letters of running text, summed from the tables of letter
# frequencies of each language; and, for all languages alike, the approximate shares of capitals among letters and of
# letters, digits, punctuation marks and symbols among the characters of words.
ACCENTED = {"en": 0.0, "fr": 0.0283, "de": 0.0232, "es": 0.0298}
CAPITALS, LETTERS, DIGITS, PUNCTUATION, OTHERS = 0.03, 0.95, 0.005, 0.044, 0.001
CLASSES = ("lower", "upper", "other", "digit", "mark", "symbol")
SHARES = {lang: (LETTERS * (1 - a) * (1 - CAPITALS), LETTERS * (1 - a) * CAPITALS, LETTERS * a, DIGITS, PUNCTUATION, OTHERS) for lang, a in ACCENTED.items()}
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
#: Largest distances of a document that is kept, and the fewest words that a comparison takes.
MAX_CLASS, MIN_CLASS_WORDS = 0.24, 100
MAX_WORDS, MIN_COMMON_WORDS = 0.30, 100
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _byte_classes() -> np.ndarray:
    """For each class a row that marks its bytes; a character of several bytes counts at its first."""
    rows = {c: np.zeros(256, np.int64) for c in CLASSES}
    for b in range(33, 256):
        ch = chr(b)
        if b >= 0x80:
            rows["other"][b] = b >= 0xC0
        else:
            rows["lower" if "a" <= ch <= "z" else "upper" if "A" <= ch <= "Z" else "digit" if ch.isdigit() else "mark" if ch in MARKS else "symbol"][b] = 1
    return np.stack([rows[c] for c in CLASSES])


_CLASS_BYTES = _byte_classes()
_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_SPACE_BYTES = np.array([9, 10, 11, 12, 13, 32])
_COMMON = {lang: (list(map(str.encode, ws)), np.array([*ws.values(), 1 - sum(ws.values())])) for lang, ws in COMMON.items()}
_VOCABULARY = {w for ws, _ in _COMMON.values() for w in ws}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, (p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()) / 2))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, at, n = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def judge(text: bytes | None) -> tuple:
    """The values of COLUMNS for one text in UTF-8; null is empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist.sum() - hist[0x80:0xC0].sum() - hist[_SPACE_BYTES].sum())
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, int(hist[_SYMBOL_BYTES].sum()), sum(lines.values()) - len(lines), repeats, failed, not failed and divergence_ok(words, hist)


def divergence_ok(words: list[bytes], hist: np.ndarray) -> bool:
    """Whether one language's references are near enough in every comparison that the text is long enough for."""
    n, near = len(words), set(SHARES)
    classes = _CLASS_BYTES @ hist
    if n >= MIN_CLASS_WORDS and classes.sum():
        near = {lang for lang, q in SHARES.items() if js_distance(classes / classes.sum(), np.array(q)) <= MAX_CLASS}
    if n < MIN_COMMON_WORDS or not near:
        return bool(near)
    seen: Counter = Counter()
    for w, k in Counter(words).items():
        if (w := w.strip(MARKS.encode()).lower()) in _VOCABULARY:
            seen[w] += k

    def distance(lang: str) -> float:
        p = np.array([seen[w] for w in _COMMON[lang][0]], float)
        return js_distance(np.append(p, n - p.sum()) / n, _COMMON[lang][1])

    return any(distance(lang) <= MAX_WORDS for lang in near)


def assess(docs: DataFrame, text_col: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs with COLUMNS appended, under `names` where given; a column of docs by such a name is replaced.

    Null and empty texts have no words and fail. Repeated rows are judged alike; no rows give no rows.
    """
    names = {c: c for c in COLUMNS} | (names or {})
    low = {x.lower() for x in names.values()}
    rest = [c for c in docs.columns if c.lower() not in low or c == text_col]
    raw = fresh([*docs.columns, *names.values()], "raw")
    kinds = [T.BooleanType() if c in ("base_failed", "kept") else T.LongType() for c in COLUMNS]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").cast("binary").alias(raw))
    out = [f for f in source.schema.fields if f.name != raw and (f.name.lower() not in low)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py()) for t in b.column(b.schema.get_field_index(raw))]
            new = [pa.array([r[j] for r in rows], pa.bool_() if isinstance(kinds[j], T.BooleanType) else pa.int64()) for j in range(len(COLUMNS))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in out), *new], names=[*(f.name for f in out), *names.values()])

    schema = T.StructType([*out, *(T.StructField(names[c], k) for c, k in zip(COLUMNS, kinds, strict=True))])
    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged, whatever their names; null and empty texts go, repeated rows stay or go alike."""
    names: dict[str, str] = {}
    for c in COLUMNS:
        names[c] = fresh([*docs.columns, *names.values()], c)
    return assess(docs, text_col, names).where(F.col(names["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each row of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs).select("doc_id", *COLUMNS)


def _sql() -> str:
    """The same rules in SQL; tables of reference values are written out from the constants above."""
    words = ", ".join(f"('{lang}', '{w}', {p!r})" for lang, ws in COMMON.items() for w, p in ws.items())
    rest = ", ".join(f"('{lang}', {1 - sum(ws.values())!r})" for lang, ws in COMMON.items())
    shares = ", ".join(f"('{lang}', {', '.join(map(repr, q))})" for lang, q in SHARES.items())
    marks = r"""[.,;:!?''"()\-]"""
    count = lambda cls: f"length(t) - length(regexp_replace(t, '{cls}', '', 'g'))"
    term = lambda p, q: f"coalesce({p} * log2(nullif({p}, 0) / (({p} + {q}) / 2)), 0) + coalesce({q} * log2(nullif({q}, 0) / (({p} + {q}) / 2)), 0)"
    classes = " + ".join(term(f"c.{x} / c.total", f"s.{x}") for x in CLASSES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count(r"[#*$%&|<>]")} AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id)),
counts AS (SELECT doc_id, {count("[a-z]")} AS lower, {count("[A-Z]")} AS upper, {count(r"[^\x00-\x7F]")} AS other, {count("[0-9]")} AS digit, {count(marks)} AS mark, {count(r"[\x21-\x7F]")} AS printable FROM d),
c AS (SELECT doc_id, lower::DOUBLE AS lower, upper::DOUBLE AS upper, other::DOUBLE AS other, digit::DOUBLE AS digit, mark::DOUBLE AS mark, (printable - lower - upper - digit - mark)::DOUBLE AS symbol, nullif(printable + other, 0)::DOUBLE AS total FROM counts),
s(lang, {", ".join(CLASSES)}) AS (VALUES {shares}),
near_class AS (SELECT doc_id, lang, sqrt(greatest(0, {classes}) / 2) AS v FROM c, s),
ref(lang, w, q) AS (VALUES {words}),
rest(lang, q) AS (VALUES {rest}),
seen AS (SELECT doc_id, lower(regexp_replace(regexp_replace(x, '^{marks}+', ''), '{marks}+$', '')) AS w, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
hits AS (SELECT b.doc_id, ref.lang, ref.q, coalesce(seen.k, 0) / b.n_words AS p FROM (SELECT * FROM base WHERE n_words >= {MIN_COMMON_WORDS}) b CROSS JOIN ref LEFT JOIN seen ON seen.doc_id = b.doc_id AND seen.w = ref.w),
by_lang AS (SELECT doc_id, lang, sum({term("p", "q")}) AS v, greatest(0, 1 - sum(p)) AS p FROM hits GROUP BY doc_id, lang),
near_words AS (SELECT doc_id, lang, sqrt(greatest(0, v + {term("p", "q")}) / 2) AS v FROM (SELECT b.doc_id, lang, b.v, b.p, rest.q FROM by_lang b JOIN rest USING (lang))),
fits AS (SELECT nc.doc_id, bool_or((b.n_words < {MIN_CLASS_WORDS} OR coalesce(nc.v, 0) <= {MAX_CLASS}) AND coalesce(nw.v, 0) <= {MAX_WORDS}) AS ok FROM near_class nc JOIN base b USING (doc_id) LEFT JOIN near_words nw USING (doc_id, lang) GROUP BY nc.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND ok AS kept
FROM failed f JOIN fits USING (doc_id)"""


SQL = _sql()
