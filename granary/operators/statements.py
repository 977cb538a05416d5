"""Statements in the dialect over the driver's tables, each with equivalent SQL for DuckDB.

Doubles are rounded after the statement, for the dialect has no such function. Where a statement needs
nulls, they are put into its table before it runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.planner import plan
from granary.sources.tables import open_table, scratch_folder
from granary.sources.tsv import convert
from granary.sql.errors import SqlError


@dataclass(frozen=True)
class Statement:
    table: str
    sql: str
    rounded: tuple[str, ...] = ()
    oracle: str | None = None  # the statement itself, but for rounding and bigint sums, if absent
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.over(open_table(spark, f"{sf_dir}/{self.table}.parquet"))

    def over(self, table: DataFrame) -> DataFrame:
        out = plan(self.sql, self.prepare(table))
        return out if not self.rounded else out.select(*(F.round(c, 6).alias(c) if c in self.rounded else F.col(f"`{c}`") for c in out.columns))

    def check(self) -> str:
        if self.oracle:
            return self.oracle
        sql = re.sub(r"SUM\(((?:[^()]|\([^()]*\))*)\)", r"CAST(SUM(\1) AS BIGINT)", self.sql)
        if not self.rounded:
            return sql
        return f"SELECT * REPLACE ({', '.join(f'ROUND({c}, 6) AS {c}' for c in self.rounded)}) FROM ({sql})"


def nulls(column: str, value: object) -> Callable[[DataFrame], DataFrame]:
    """A column with its values that equal `value` turned to nulls."""
    return lambda df: df.withColumn(column, F.nullif(F.col(column), F.lit(value)))


def wrapped(sql: str) -> str:
    """SQL for a 128-bit value as the 64-bit integer that is left of it."""
    return f"CAST((({sql} + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT)"


# The shapes of the statements q00 to q42, so that their times compare; tables and columns are others.
VIEWS = "l_suppkey = 62 AND l_shipdate >= '1996-01-01' AND l_shipdate <= '2000-12-31' AND l_linenumber <> 7"
HOST = r"'^https?://(?:www\.)?([^/]+)/.*$', '\1'"

STATEMENTS: dict[str, Statement] = {
    "q00": Statement("events", "SELECT COUNT(*) AS c FROM events"),
    "q01": Statement("lineitem", "SELECT COUNT(*) AS c FROM lineitem WHERE l_linenumber <> 1"),
    "q02": Statement("lineitem", "SELECT SUM(l_linenumber) AS s, COUNT(*) AS c, AVG(l_quantity) AS a FROM lineitem", ("a",)),
    "q03": Statement("lineitem", "SELECT AVG(l_orderkey) AS a FROM lineitem", ("a",)),
    "q04": Statement("events", "SELECT COUNT(DISTINCT user_id) AS u FROM events"),
    "q05": Statement("part", "SELECT COUNT(DISTINCT p_name) AS u FROM part"),
    "q06": Statement("orders", "SELECT MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi FROM orders"),
    "q07": Statement("lineitem", "SELECT l_linenumber, COUNT(*) AS c FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_linenumber ORDER BY COUNT(*) DESC"),
    "q08": Statement("events", "SELECT event_type, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10"),
    "q09": Statement("lineitem", "SELECT l_suppkey, SUM(l_linenumber) AS s, COUNT(*) AS c, AVG(l_quantity) AS a, COUNT(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10", ("a",)),
    "q10": Statement("documents", "SELECT source, COUNT(DISTINCT lang) AS u FROM documents WHERE source <> '' GROUP BY source ORDER BY u DESC, source LIMIT 10"),
    "q11": Statement("part", "SELECT p_size, p_brand, COUNT(DISTINCT p_name) AS u FROM part WHERE p_brand <> '' GROUP BY p_size, p_brand ORDER BY u DESC, p_size, p_brand LIMIT 10"),
    "q12": Statement("part", "SELECT p_name, COUNT(*) AS c FROM part WHERE p_name <> '' GROUP BY p_name ORDER BY c DESC, p_name LIMIT 10"),
    "q13": Statement("orders", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS u FROM orders WHERE o_orderpriority <> '' GROUP BY o_orderpriority ORDER BY u DESC, o_orderpriority LIMIT 10"),
    "q14": Statement("part", "SELECT p_size, p_type, COUNT(*) AS c FROM part WHERE p_type <> '' GROUP BY p_size, p_type ORDER BY c DESC, p_size, p_type LIMIT 10"),
    "q15": Statement("orders", "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10"),
    "q16": Statement("events", "SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type ORDER BY COUNT(*) DESC, user_id, event_type LIMIT 10"),
    "q17": Statement("events", "SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type ORDER BY user_id, event_type LIMIT 10"),
    "q18": Statement("events", "SELECT user_id, extract(minute FROM ts) AS m, event_type, COUNT(*) AS c FROM events GROUP BY user_id, m, event_type ORDER BY COUNT(*) DESC, user_id, m, event_type LIMIT 10"),
    "q19": Statement("orders", "SELECT o_custkey FROM orders WHERE o_custkey = 899"),
    "q20": Statement("pages", "SELECT COUNT(*) AS c FROM pages WHERE url LIKE '%example.com%'"),
    "q21": Statement("documents", "SELECT lang, MIN(source) AS m, COUNT(*) AS c FROM documents WHERE text LIKE '%the%' AND lang <> '' GROUP BY lang ORDER BY c DESC, lang LIMIT 10"),
    "q22": Statement("documents", "SELECT lang, MIN(source) AS m, MIN(text) AS t, COUNT(*) AS c, COUNT(DISTINCT n_chars) AS u FROM documents WHERE text LIKE '%the%' AND text NOT LIKE '%.google.%' AND lang <> '' GROUP BY lang ORDER BY c DESC, lang LIMIT 10"),
    "q23": Statement("pages", "SELECT * FROM pages WHERE url LIKE '%example.com%' ORDER BY page_id LIMIT 10"),
    "q24": Statement("events", "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10"),
    "q25": Statement("part", "SELECT p_name FROM part WHERE p_name <> '' ORDER BY p_name LIMIT 10"),
    "q26": Statement("events", "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_type LIMIT 10"),
    "q27": Statement("documents", "SELECT lang, AVG(LENGTH(text)) AS l, COUNT(*) AS c FROM documents WHERE text <> '' GROUP BY lang HAVING COUNT(*) > 50 ORDER BY l DESC LIMIT 25", ("l",)),
    "q28": Statement(
        "pages",
        f"SELECT REGEXP_REPLACE(url, {HOST}) AS k, AVG(STRLEN(url)) AS l, COUNT(*) AS c, MIN(url) AS m FROM pages WHERE url <> '' GROUP BY k HAVING COUNT(*) > 1 ORDER BY l DESC, k LIMIT 25",
        ("l",),
        f"SELECT regexp_replace(url, {HOST}, 'g') AS k, ROUND(AVG(LENGTH(url)), 6) AS l, COUNT(*) AS c, MIN(url) AS m FROM pages WHERE url <> '' GROUP BY k HAVING COUNT(*) > 1 ORDER BY AVG(LENGTH(url)) DESC, k LIMIT 25",
    ),
    "q29": Statement("lineitem", "SELECT " + ", ".join(f"SUM(l_linenumber + {k}) AS s{k}" for k in range(90)) + " FROM lineitem"),
    "q30": Statement("lineitem", "SELECT l_linenumber, l_suppkey, COUNT(*) AS c, SUM(l_linenumber) AS s, AVG(l_quantity) AS a FROM lineitem WHERE l_returnflag <> '' GROUP BY l_linenumber, l_suppkey ORDER BY c DESC, l_linenumber, l_suppkey LIMIT 10", ("a",)),
    "q31": Statement("lineitem", "SELECT l_orderkey, l_suppkey, COUNT(*) AS c, SUM(l_linenumber) AS s, AVG(l_quantity) AS a FROM lineitem WHERE l_returnflag <> '' GROUP BY l_orderkey, l_suppkey ORDER BY c DESC, l_orderkey, l_suppkey LIMIT 10", ("a",)),
    "q32": Statement("lineitem", "SELECT l_orderkey, l_suppkey, COUNT(*) AS c, SUM(l_linenumber) AS s, AVG(l_quantity) AS a FROM lineitem GROUP BY l_orderkey, l_suppkey ORDER BY c DESC, l_orderkey, l_suppkey LIMIT 10", ("a",)),
    "q33": Statement("pages", "SELECT url, COUNT(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10"),
    "q34": Statement("pages", "SELECT 1 AS one, url, COUNT(*) AS c FROM pages GROUP BY 1, url ORDER BY c DESC, url LIMIT 10", (), "SELECT CAST(1 AS BIGINT) AS one, url, COUNT(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10"),
    "q35": Statement("orders", "SELECT o_custkey, o_custkey - 1 AS k1, o_custkey - 2 AS k2, o_custkey - 3 AS k3, COUNT(*) AS c FROM orders GROUP BY o_custkey, o_custkey - 1, o_custkey - 2, o_custkey - 3 ORDER BY c DESC, o_custkey LIMIT 10"),
    "q36": Statement("lineitem", f"SELECT l_partkey, COUNT(*) AS PageViews FROM lineitem WHERE {VIEWS} AND l_returnflag <> '' GROUP BY l_partkey ORDER BY PageViews DESC, l_partkey LIMIT 10"),
    "q37": Statement("lineitem", f"SELECT l_returnflag, COUNT(*) AS PageViews FROM lineitem WHERE {VIEWS} AND l_linestatus <> '' GROUP BY l_returnflag ORDER BY PageViews DESC, l_returnflag LIMIT 10"),
    "q38": Statement("lineitem", f"SELECT l_partkey, COUNT(*) AS PageViews FROM lineitem WHERE {VIEWS} GROUP BY l_partkey ORDER BY PageViews DESC, l_partkey LIMIT 10 OFFSET 100"),
    "q39": Statement("lineitem", f"SELECT l_linenumber, l_linestatus, CASE WHEN (l_linenumber = 1 AND l_linestatus = 'O') THEN l_returnflag ELSE '' END AS Src, l_partkey AS Dst, COUNT(*) AS PageViews FROM lineitem WHERE {VIEWS} GROUP BY l_linenumber, l_linestatus, Src, Dst ORDER BY PageViews DESC, l_linenumber, l_linestatus, Src, Dst LIMIT 10 OFFSET 100"),
    "q40": Statement("orders", "SELECT o_custkey, o_orderstatus, COUNT(*) AS PageViews FROM orders WHERE o_custkey IN (-1, 6, 899, 769) AND o_orderpriority = '5-LOW' GROUP BY o_custkey, o_orderstatus ORDER BY PageViews DESC, o_custkey, o_orderstatus LIMIT 10 OFFSET 2"),
    "q41": Statement("part", "SELECT p_size, p_brand, COUNT(*) AS PageViews FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 40 GROUP BY p_size, p_brand ORDER BY PageViews DESC, p_size, p_brand LIMIT 10 OFFSET 100"),
    "q42": Statement(
        "events",
        "SELECT DATE_TRUNC('minute', ts) AS M, COUNT(*) AS PageViews FROM events WHERE event_type = 'click' GROUP BY DATE_TRUNC('minute', ts) ORDER BY DATE_TRUNC('minute', ts) LIMIT 10 OFFSET 1000",
        (),
        "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS M, COUNT(*) AS PageViews FROM events WHERE event_type = 'click' GROUP BY date_trunc('minute', ts) ORDER BY date_trunc('minute', ts) LIMIT 10 OFFSET 1000",
    ),
    "x_null_count": Statement("lineitem", "SELECT COUNT(l_linenumber) AS n, COUNT(*) AS c, SUM(l_linenumber) AS s FROM lineitem", (), "SELECT COUNT(NULLIF(l_linenumber, 1)) AS n, COUNT(*) AS c, CAST(SUM(NULLIF(l_linenumber, 1)) AS BIGINT) AS s FROM lineitem", nulls("l_linenumber", 1)),
    "x_sum_distinct": Statement("part", "SELECT SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a, MIN(DISTINCT p_size) AS lo, MAX(DISTINCT p_size) AS hi FROM part", ("a",)),
    "x_intdiv": Statement("part", "SELECT p_partkey, p_size / (p_size - 11) AS d, (0 - p_size) % (p_size - 11) AS m FROM part", (), "SELECT p_partkey, CAST(p_size // NULLIF(p_size - 11, 0) AS BIGINT) AS d, CAST((0 - p_size) % NULLIF(p_size - 11, 0) AS BIGINT) AS m FROM part"),
    "x_doublediv": Statement("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS d, -l_tax AS n, l_extendedprice % 7.5 AS r FROM lineitem"),
    "x_in_null": Statement("part", "SELECT COUNT(*) AS c FROM part WHERE p_size NOT IN (1, NULL)"),
    "x_3vl": Statement("part", "SELECT COUNT(*) AS c FROM part WHERE p_size > 5 OR p_brand = 'Brand#2'", (), "SELECT COUNT(*) AS c FROM part WHERE NULLIF(p_size, 11) > 5 OR p_brand = 'Brand#2'", nulls("p_size", 11)),
    "x_not_3vl": Statement("part", "SELECT COUNT(*) AS c FROM part WHERE NOT (p_size > 5 AND p_brand <> 'Brand#2')", (), "SELECT COUNT(*) AS c FROM part WHERE NOT (NULLIF(p_size, 11) > 5 AND p_brand <> 'Brand#2')", nulls("p_size", 11)),
    "x_like_us": Statement("part", "SELECT COUNT(*) AS c FROM part WHERE p_brand LIKE 'Brand#_'"),
    "x_like_shapes": Statement("part", "SELECT p_type, COUNT(*) AS c FROM part WHERE p_type LIKE 'E%' OR p_type LIKE '%D' OR p_type LIKE '%A%' OR p_type NOT LIKE 'PROMO' GROUP BY p_type"),
    "x_empty_agg": Statement("part", "SELECT COUNT(*) AS c, MAX(p_size) AS m FROM part WHERE p_size > 100000"),
    "x_group_null": Statement("part", "SELECT p_size AS k, COUNT(*) AS c FROM part GROUP BY p_size", (), "SELECT NULLIF(p_size, 11) AS k, COUNT(*) AS c FROM part GROUP BY 1", nulls("p_size", 11)),
    "x_is_null": Statement("part", "SELECT p_size IS NULL AS gone, COUNT(*) AS c FROM part WHERE p_name IS NOT NULL GROUP BY p_size IS NULL", (), "SELECT NULLIF(p_size, 11) IS NULL AS gone, COUNT(*) AS c FROM part WHERE p_name IS NOT NULL GROUP BY 1", nulls("p_size", 11)),
    "x_order_nulls": Statement("part", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 20 OFFSET 185", (), "SELECT p_partkey, NULLIF(p_size, 11) AS p_size FROM part ORDER BY 2 NULLS LAST, 1 LIMIT 20 OFFSET 185", nulls("p_size", 11)),
    "x_keys_only": Statement("part", "SELECT p_brand FROM part GROUP BY p_brand"),
    "x_post_aggregate": Statement("lineitem", "SELECT l_returnflag, SUM(l_quantity) / COUNT(*) AS q, SUM(l_linenumber) / COUNT(*) AS n FROM lineitem GROUP BY l_returnflag HAVING MIN(l_linenumber) = 1", ("q",), "SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*), 6) AS q, CAST(SUM(l_linenumber) // COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag HAVING MIN(l_linenumber) = 1"),
    "x_case": Statement("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2.5 END AS v, CASE WHEN p_size < 10 THEN p_brand ELSE 'none' END AS b FROM part", (), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2.5 END::DOUBLE AS v, CASE WHEN p_size < 10 THEN p_brand ELSE 'none' END AS b FROM part"),
    "x_fields": Statement("orders", "SELECT extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, COUNT(*) AS c FROM orders GROUP BY y, m, d"),
    "x_trunc_text": Statement(
        "orders",
        "SELECT date_trunc('month', o_orderdate) AS m, extract(hour FROM o_orderdate) AS h, COUNT(*) AS c FROM orders GROUP BY m, h",
        (),
        "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS m, CAST(0 AS BIGINT) AS h, COUNT(*) AS c FROM orders GROUP BY 1",
        lambda df: df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")),
    ),
    "x_regexp_all": Statement("part", r"SELECT p_partkey, regexp_replace(p_name, '([aeiou])([a-z])', '\2\1') AS r FROM part", (), r"SELECT p_partkey, regexp_replace(p_name, '([aeiou])([a-z])', '\2\1', 'g') AS r FROM part"),
    "x_point": Statement("customer", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 77"),
    "x_string_order": Statement("customer", "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer WHERE c_mktsegment >= 'F' GROUP BY c_mktsegment ORDER BY c_mktsegment DESC"),
    "x_bool": Statement("nation", "SELECT n_nationkey, n_regionkey = 1 AS is_one, NOT TRUE AS no FROM nation WHERE TRUE"),
    "x_dims": Statement("supplier", "SELECT s_nationkey, COUNT(*) AS c, AVG(s_acctbal) AS a FROM supplier GROUP BY s_nationkey ORDER BY c DESC, s_nationkey LIMIT 5", ("a",)),
    "x_regions": Statement("region", "SELECT r_regionkey, STRLEN(r_name) AS n FROM region ORDER BY r_regionkey LIMIT 3 OFFSET 1", (), "SELECT r_regionkey, LENGTH(r_name) AS n FROM region ORDER BY r_regionkey LIMIT 3 OFFSET 1"),
    "x_reserved": Statement("region", 'SELECT r_regionkey AS "select", r_name AS "Group By" FROM region WHERE "r_regionkey" >= 2'),
    "x_chained": Statement("part", "SELECT COUNT(*) AS c FROM part WHERE p_size > 10 = TRUE <> (p_size < 20)", (), "SELECT COUNT(*) AS c FROM part WHERE ((p_size > 10) = TRUE) <> (p_size < 20)"),
    "x_precedence": Statement("part", "SELECT p_partkey, 2 + p_size * 3 - 4 / 2 % 3 AS v, NOT p_size = 5 AND p_size < 9 OR p_size > 40 AS b FROM part;", (), "SELECT p_partkey, CAST(2 + p_size * 3 - ((4 // 2) % 3) AS BIGINT) AS v, ((NOT (p_size = 5)) AND p_size < 9) OR p_size > 40 AS b FROM part"),
    "x_int_literals": Statement("region", "SELECT r_regionkey, 9223372036854775807 AS hi, -9223372036854775807 AS lo, 007 AS seven FROM region", (), "SELECT r_regionkey, 9223372036854775807 AS hi, -9223372036854775807 AS lo, CAST(7 AS BIGINT) AS seven FROM region"),
    "x_default_names": Statement("part", "SELECT p_brand, COUNT(*), MAX(p_size), COUNT(DISTINCT p_type), MAX(p_size) + 1 FROM part GROUP BY p_brand", (), 'SELECT p_brand, COUNT(*) AS "count_star()", MAX(p_size) AS "max(p_size)", COUNT(DISTINCT p_type) AS "count(DISTINCT p_type)", CAST(MAX(p_size) + 1 AS BIGINT) AS "(max(p_size) PLUS 1)" FROM part GROUP BY p_brand'),
    "x_column_case": Statement("nation", "SELECT N_NAME, n_RegionKey AS r FROM nation WHERE N_NationKey < 10", (), 'SELECT n_name AS "N_NAME", n_regionkey AS r FROM nation WHERE n_nationkey < 10'),
    "x_not_between": Statement("part", "SELECT p_partkey, p_size NOT BETWEEN 10 AND 30 AS out FROM part WHERE p_partkey NOT BETWEEN 5 AND 100", (), "SELECT p_partkey, NULLIF(p_size, 11) NOT BETWEEN 10 AND 30 AS out FROM part WHERE p_partkey NOT BETWEEN 5 AND 100", nulls("p_size", 11)),
    "x_double_compare": Statement("lineitem", "SELECT l_discount > l_tax AS more, l_tax <= 0.04 AS low, l_quantity = 17 AS same, COUNT(*) AS c FROM lineitem GROUP BY more, low, same"),
    "x_wrap": Statement("lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey * 4611686018427387903 AS m, l_orderkey + 9223372036854775807 AS p, -9223372036854775807 - l_orderkey AS d FROM lineitem", (), f"SELECT l_orderkey, l_linenumber, {wrapped('l_orderkey::HUGEINT * 4611686018427387903')} AS m, {wrapped('l_orderkey::HUGEINT + 9223372036854775807')} AS p, {wrapped('-9223372036854775807::HUGEINT - l_orderkey')} AS d FROM lineitem"),
    "x_wrap_sum": Statement("lineitem", "SELECT l_returnflag, SUM(l_partkey * 4611686018427387903) AS s, SUM(l_partkey + 4611686018427387903) AS t FROM lineitem GROUP BY l_returnflag", (), f"SELECT l_returnflag, {wrapped('SUM(l_partkey::HUGEINT * 4611686018427387903)')} AS s, {wrapped('SUM(l_partkey::HUGEINT + 4611686018427387903)')} AS t FROM lineitem GROUP BY l_returnflag"),
    "x_garbage_dates": Statement(
        "customer",
        "SELECT c_custkey, extract(year FROM c_name) AS y, extract(month FROM c_name) AS mo, extract(hour FROM c_name) AS h, extract(minute FROM c_name) AS mi, extract(second FROM c_name) AS s, date_trunc('day', c_mktsegment) AS d FROM customer",
        (),
        "SELECT c_custkey, " + ", ".join(f"CASE WHEN length(c_name) < {least} THEN 0 WHEN regexp_full_match(substr(c_name, {at}, {n}), '[+-]?[0-9]+') AND length(substr(c_name, {at}, {n})) = {n} THEN CAST(substr(c_name, {at}, {n}) AS BIGINT) END::BIGINT AS {name}" for name, at, n, least in (("y", 1, 4, 0), ("mo", 6, 2, 0), ("h", 12, 2, 13), ("mi", 15, 2, 16), ("s", 18, 2, 19))) + ", CASE WHEN length(c_mktsegment) = 10 THEN c_mktsegment || ' 00:00:00' WHEN length(c_mktsegment) >= 19 THEN substr(c_mktsegment, 1, 10) || ' 00:00:00' END AS d FROM customer",
    ),
}

#: Statements that the binder refuses, by the rule that they break.
REJECTED = {
    "aggregate of an aggregate": "SELECT SUM(COUNT(p_size)) FROM part",
    "aggregate in WHERE": "SELECT p_size FROM part WHERE COUNT(*) > 1",
    "arithmetic on a text": "SELECT p_name + 1 FROM part",
    "chained comparison of unlike kinds": "SELECT p_size < 1 < 2 FROM part",
    "DISTINCT in a scalar call": "SELECT STRLEN(DISTINCT p_name) FROM part",
    "integer out of range": "SELECT 9223372036854775808 FROM part",
    "number compared with a text": "SELECT p_size FROM part WHERE p_name = 1",
    "qualified name": "SELECT part.p_size FROM part",
    "unknown column": "SELECT nope FROM part",
    "unterminated text": "SELECT 'p FROM part",
}


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, rejected): whether each statement of REJECTED is refused when it is planned."""
    part = open_table(spark, f"{sf_dir}/part.parquet")

    def refused(sql: str) -> bool:
        try:
            plan(sql, part)
        except SqlError:
            return True
        return False

    return spark.createDataFrame([(rule, refused(sql)) for rule, sql in REJECTED.items()], "rule string, rejected boolean")


TSV_SQL = "SELECT c_mktsegment, COUNT(*) AS c, SUM(c_custkey) AS s, MIN(c_name) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment"


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table customer written as tab-separated files with headers, loaded with inferred types, and aggregated."""
    folder = scratch_folder(spark)
    customer = open_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    customer.repartition(20).write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/tsv")
    return plan(TSV_SQL, convert(spark, f"{folder}/tsv", f"{folder}/table", header=True))


QUERIES = {name: s.run for name, s in STATEMENTS.items()} | {"x_rejected": rejections, "x_tsv": tsv_round_trip}
ORACLE_SQL = {name: s.check() for name, s in STATEMENTS.items()} | {
    "x_rejected": "SELECT * FROM (VALUES " + ", ".join(f"('{rule}', TRUE)" for rule in REJECTED) + ") AS r(rule, rejected)",
    "x_tsv": TSV_SQL.replace("SUM(c_custkey)", "CAST(SUM(c_custkey) AS BIGINT)"),
}
