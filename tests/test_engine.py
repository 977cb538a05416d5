"""Statements over small frames: each operator's semantics."""

import pytest
from pyspark.sql import functions as F

from granary.api import query
from granary.functions.dialect import java_replacement
from granary.plans.planner import plan
from granary.sql.errors import SqlError


@pytest.fixture(scope="module")
def run(spark):
    def go(schema, rows, sql):
        return [tuple(r) for r in plan(sql, spark.createDataFrame(rows, schema)).collect()]

    return go


#: A harbour's log: berth, ship, tons loaded, the hour's wind, and the day.
PORT = [(4, "Möwe", 120, 3.5, "2021-11-30"), (4, "Albatros", 80, 7.25, "2021-12-01"), (9, "Möwe", -5, None, "2021-12-31"), (9, None, None, 0.5, "2022-01-01"), (None, "Älv", 40, 12.0, "2021-12-07")]
SHIPS = "berth int, ship string, tons int, wind double, day string"


@pytest.mark.parametrize(
    "schema, rows, sql, expected",
    [
        (SHIPS, PORT, "SELECT COUNT(*), COUNT(berth), COUNT(tons), COUNT(DISTINCT ship) FROM t", [(5, 4, 4, 3)]),
        (SHIPS, PORT, "SELECT ship, tons FROM t WHERE tons <> 80 ORDER BY tons", [("Möwe", -5), ("Älv", 40), ("Möwe", 120)]),
        (SHIPS, PORT, "SELECT berth, SUM(tons), AVG(wind), SUM(wind), MIN(day), MAX(ship) FROM t GROUP BY berth ORDER BY berth", [(4, 200, 5.375, 10.75, "2021-11-30", "Möwe"), (9, -5, 0.5, 0.5, "2021-12-31", "Möwe"), (None, 40, 12.0, 12.0, "2021-12-07", "Älv")]),
        (SHIPS, PORT, "SELECT ship, COUNT(*) AS calls FROM t GROUP BY ship HAVING COUNT(*) >= 2 OR ship IS NULL ORDER BY calls DESC", [("Möwe", 2), (None, 1)]),
        (SHIPS, PORT, "SELECT ship FROM t WHERE wind BETWEEN 0.5 AND 7.25 AND berth IN (4, 7) ORDER BY wind DESC", [("Albatros",), ("Möwe",)]),
        (SHIPS, PORT, "SELECT COUNT(*), MIN(wind), SUM(tons), AVG(tons), MAX(day) FROM t WHERE tons < -5", [(0, None, None, None, None)]),
        (SHIPS, PORT, "SELECT day FROM t WHERE day > '2021-11-30' AND day < '2022' ORDER BY day DESC", [("2021-12-31",), ("2021-12-07",), ("2021-12-01",)]),
        (SHIPS, PORT, "SELECT berth, AVG(LENGTH(ship)) AS l, MAX(STRLEN(ship)) FROM t GROUP BY berth ORDER BY l, berth", [(None, 3.0, 3), (9, 4.0, 4), (4, 6.0, 8)]),
        ("x int", [(1,), (None,)], "SELECT COUNT(*) FROM t WHERE x NOT IN (2, NULL)", [(0,)]),
        ("x int", [(1,), (None,)], "SELECT COUNT(*) FROM t WHERE NOT (x = 2)", [(1,)]),
        ("x int, y int", [(-7, 2), (7, 0), (-7, 3)], "SELECT x / y, x % y FROM t", [(-3, -1), (None, None), (-2, -1)]),
        ("x double", [(7.0,)], "SELECT x / 0.0, x % 0, x / 2 FROM t", [(None, None, 3.5)]),
        ("x int", [(2147483647,)], "SELECT x + 1, x * 2, -x FROM t", [(2147483648, 4294967294, -2147483647)]),
        (SHIPS, PORT, "SELECT SUM(tons + 1), SUM(tons - 10), SUM(1000 + tons), SUM(tons) FROM t", [(239, 195, 4235, 235)]),
        ("x long", [(2**63 - 1,), (2**62,)], "SELECT x + 1, x * 4, -x - 2 FROM t WHERE x > 4611686018427387904", [(-(2**63), -4, 2**63 - 1)]),
        ("x long", [(2**63 - 1,), (2**63 - 1,), (5,)], "SELECT SUM(x), SUM(x + 1), SUM(DISTINCT x) FROM t", [(3, 6, -(2**63) + 4)]),
        ("x int", [(None,)], "SELECT SUM(x + 1) FROM t", [(None,)]),
        ("x int", [(1,), (1,), (3,)], "SELECT SUM(DISTINCT x), AVG(DISTINCT x), MIN(DISTINCT x), MAX(DISTINCT x) FROM t", [(4, 2.0, 1, 3)]),
        ("s string", [("Zürich ☂",), ("𝄞",), (" ",), (None,)], "SELECT STRLEN(s), LENGTH(s) FROM t", [(8, 8), (1, 1), (1, 1), (None, None)]),
        ("a int, b int", [(1, 10), (1, 20), (2, 5)], "SELECT a, SUM(b) / COUNT(*) AS m FROM t GROUP BY a ORDER BY m DESC", [(1, 15), (2, 5)]),
        ("a int", [(3,), (None,), (1,)], "SELECT a FROM t ORDER BY a", [(1,), (3,), (None,)]),
        ("a int", [(3,), (None,), (1,)], "SELECT a FROM t ORDER BY a DESC", [(3,), (1,), (None,)]),
        ("k int, s string", [(1, "b"), (2, "a"), (3, "c")], "SELECT s FROM t ORDER BY k DESC LIMIT 1 OFFSET 1", [("a",)]),
        ("a int, b int", [(1, 5), (2, 5)], "SELECT b AS a, COUNT(*) FROM t GROUP BY a", [(5, 2)]),
        ("a int, b int", [(1, 9), (2, 5)], "SELECT *, b AS a FROM t ORDER BY a", [(2, 5, 5), (1, 9, 9)]),
        ("a int", [(1,), (1,), (2,)], "SELECT 1, COUNT(*) FROM t GROUP BY 1", [(1, 3)]),
        ("a int", [], "SELECT COUNT(*) FROM t GROUP BY 1", []),
        ("a int", [(4,), (4,)], "SELECT a, a - 1, a - 2, COUNT(*) FROM t GROUP BY a, a - 1, a - 2", [(4, 3, 2, 2)]),
        ("a int", [(1,), (1,), (2,)], "SELECT a FROM t GROUP BY a ORDER BY a", [(1,), (2,)]),
        ("a int, b int", [(None, 1), (None, 2), (1, None)], "SELECT a, b, COUNT(*) FROM t GROUP BY a, b ORDER BY a, b", [(1, None, 1), (None, 1, 1), (None, 2, 1)]),
        ("x int", [(1,), (5,), (9,)], "SELECT CASE WHEN x < 3 THEN 1 WHEN x < 7 THEN 2.5 END FROM t", [(1.0,), (2.5,), (None,)]),
        ("x int, s string", [(1, "a"), (5, "b")], "SELECT CASE WHEN x < 3 THEN x ELSE s END FROM t", [("1",), ("b",)]),
        ("X int, y int", [(1, 2)], "SELECT x, Y, * FROM t", [(1, 2, 1, 2)]),
        ("a int", [(1,), (2,)], "SELECT a FROM t ORDER BY 1 LIMIT 5", [(1,), (2,)]),
        ("b boolean", [(True,), (False,), (None,)], "SELECT COUNT(*) FROM t WHERE b OR FALSE", [(1,)]),
        ("a int", [(1,), (3,)], "SELECT AVG(a) > 1.5 FROM t", [(True,)]),
    ],
)
def test_results(run, schema, rows, sql, expected):
    got = run(schema, rows, sql)
    assert got == expected if "ORDER BY" in sql else sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize(
    "pattern, expected",
    [("port%", ["port", "port of call"]), ("%port", ["airport", "c:\\port", "port"]), ("%port%", ["airport", "c:\\port", "port", "port of call", "two\nports"]), ("port", ["port"]), ("5_m", ["50m", "5_m"]), ("c:\\_ort", ["c:\\port"]), ("%\n%", ["two\nports"]), ("", []), ("p%o%c_ll", ["port of call"])],
)
def test_like(run, pattern, expected):
    rows = [(x,) for x in ("port", "port of call", "airport", "50m", "5_m", "c:\\port", "two\nports", None)]
    assert sorted(r[0] for r in run("s string", rows, f"SELECT s FROM t WHERE s LIKE '{pattern}'")) == sorted(expected)
    assert [r[0] for r in run("s string, p string", [(*r, pattern) for r in rows], "SELECT s FROM t WHERE s LIKE p ORDER BY s")] == sorted(expected)


@pytest.mark.parametrize("field, value", [("year", 1999), ("month", 12), ("day", 5), ("dayofmonth", 5), ("hour", 6), ("minute", 0), ("second", 59)])
def test_extract(run, spark, field, value):
    assert run("s string", [("1999-12-05 06:00:59",)], f"SELECT extract({field} FROM s) FROM t") == [(value,)]
    times = spark.createDataFrame([("1999-12-05 06:00:59",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("s"))
    assert plan(f"SELECT extract({field} FROM s) FROM t", times).collect()[0][0] == value


def test_extract_odd_texts(run):
    assert run("s string", [("1999-12-05",)], "SELECT extract(hour FROM s), extract(minute FROM s) FROM t") == [(0, 0)]
    assert run("s string", [("some words",)], "SELECT extract(year FROM s), extract(hour FROM s) FROM t") == [(None, 0)]


@pytest.mark.parametrize(
    "precision, text, expected",
    [("minute", "1999-12-05 06:00:59", "1999-12-05 06:00:00"), ("hour", "1999-12-05 06:00:59", "1999-12-05 06:00:00"), ("day", "1999-12-05 06:00:59", "1999-12-05 00:00:00"), ("month", "1999-12-05 06:00:59", "1999-12-01 00:00:00"), ("year", "1999-12-05 06:00:59", "1999-01-01 00:00:00"), ("second", "1999-12-05 06:00:59.5", "1999-12-05 06:00:59"), ("day", "1999-12-05", "1999-12-05 00:00:00"), ("minute", "some words", "some words 00:00:00"), ("day", "short", None)],
)
def test_date_trunc(run, precision, text, expected):
    assert run("s string", [(text,)], f"SELECT date_trunc('{precision}', s) FROM t") == [(expected,)]


def test_regexp_replace(run):
    host = r"'^https?://(?:www\.)?([^/]+)/.*$', '\1'"
    assert run("s string", [("https://www.quay.example/a/b?c",), ("http://quay.example",), ("no address",)], f"SELECT regexp_replace(s, {host}) FROM t") == [("quay.example",), ("http://quay.example",), ("no address",)]
    assert run("s string", [("7 of 19",), ("none",)], "SELECT regexp_replace(s, '[0-9]+', '#') FROM t") == [("# of #",), ("none",)]
    assert run("s string, r string", [("a1", r"\1$\\"), ("b2", None)], "SELECT regexp_replace(s, '([a-z])', r) FROM t") == [("a$\\1",), (None,)]


@pytest.mark.parametrize("given, expected", [(r"\1 \2", "$1 $2"), ("$5", r"\$5"), ("\\\\", "\\\\"), (r"\x", "x")])
def test_replacement_translation(given, expected):
    assert java_replacement(given) == expected


@pytest.mark.parametrize(
    "sql",
    ["SELECT nope FROM t", "SELECT a FROM t WHERE a", "SELECT a FROM t WHERE s = 1", "SELECT s + 1 FROM t", "SELECT SUM(s) FROM t", "SELECT a, COUNT(*) FROM t", "SELECT a FROM t WHERE COUNT(*) > 1", "SELECT SUM(COUNT(a)) FROM t", "SELECT STRLEN(a) FROM t", "SELECT STRLEN(DISTINCT s) FROM t", "SELECT nofn(a) FROM t", "SELECT a < 1 < 2 FROM t", "SELECT SUM(*) FROM t", "SELECT COUNT(a, s) FROM t", "SELECT a AS x FROM t WHERE x = 1", "SELECT a FROM t GROUP BY COUNT(*)", "SELECT extract(era FROM s) FROM t", "SELECT a LIKE 'x' FROM t"],
)
def test_rejected(spark, sql):
    with pytest.raises(SqlError):
        plan(sql, spark.createDataFrame([(1, "x")], "a int, s string"))


def test_names_and_laziness(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x")], "a int, s string")
    assert plan("SELECT COUNT(*), a + 1, s FROM t GROUP BY a, s", frame).columns == ["count_star()", "(a PLUS 1)", "s"]
    frame.write.parquet(str(tmp_path / "t"))
    assert query(spark, str(tmp_path / "t"), "SELECT s FROM t WHERE a = 1").collect()[0][0] == "x"


def test_pushdown_and_top_k(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).select("id", F.lit("x").alias("s"), F.col("id").cast("int").alias("n")).write.parquet(path)
    out = query(spark, path, "SELECT n FROM t WHERE n > 5 AND s LIKE 'x%' ORDER BY n DESC LIMIT 3")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in text and "StringStartsWith(s,x)" in text and "TakeOrderedAndProject" in text and "id" not in text.split("ReadSchema")[1]
