"""HTTP service and command line."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from granary import cli
from granary.server import answer, make_server
from granary.sources.tables import table_exists
from granary.sql.errors import SqlError


@pytest.fixture(scope="module")
def url(spark):
    frame = spark.createDataFrame([(1, "ch"), (2, "de"), (3, "ch"), (4, None), (5, "x" * 100)], "id int, country string")
    server = make_server(frame, "people", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_routes(url):
    assert cli.fetch(f"{url}/health") == (200, {"status": "ok", "rowCount": 5})
    schema = cli.fetch(f"{url}/schema")[1]
    assert schema["name"] == "people" and [c["type"] for c in schema["columns"]] == ["I32", "STRING"]
    status, body = cli.fetch(f"{url}/query", "SELECT country, COUNT(*) AS n FROM t GROUP BY country ORDER BY n DESC, country LIMIT 1")
    assert status == 200 and body["rows"] == [["ch", 2]] and body["rowCount"] == 1 and [c["name"] for c in body["columns"]] == ["country", "n"]
    assert {"elapsedMs", "elapsedNanos"} <= body.keys()
    assert cli.fetch(f"{url}/query", "SELECT nope FROM t")[0] == 400
    assert cli.fetch(f"{url}/query")[0] == 405
    assert cli.fetch(f"{url}/schema", "x")[0] == 405
    assert cli.fetch(f"{url}/nothing")[0] == 404
    with urllib.request.urlopen(url) as r:
        assert r.headers["Content-Type"].startswith("text/html") and b"<textarea" in r.read()


def test_command_line(url):
    out, err = io.StringIO(), io.StringIO()
    assert cli.run_query(url, "SELECT country FROM t WHERE id >= 3 ORDER BY id", out, err) == 0
    text = out.getvalue()
    assert "∅" in text and "…" in text and text.rstrip().startswith("country") and "(3 rows in" in text
    assert cli.run_query(url, "SELECT", out, err) == 1 and "error" in err.getvalue()
    assert cli.run_query("http://127.0.0.1:9", "SELECT 1 FROM t", out, err) == 1


def test_prompt(url):
    out, err = io.StringIO(), io.StringIO()
    lines = ["\\h\n", "schema\n", "SELECT ';' AS semi,\n", "id FROM t WHERE id = 1; SELECT COUNT(*) FROM t;\n", "\\q\n", "SELECT nope FROM t;\n"]
    assert cli.repl(url, lines, out, err) == 0
    assert "country STRING" in out.getvalue() and "semi" in out.getvalue() and "count_star()" in out.getvalue() and not err.getvalue()


def test_statement_split():
    assert cli.split_statement("a ';' b; c") == ("a ';' b", " c")
    assert cli.split_statement("open 'x;") == (None, "open 'x;")
    assert cli.split_statement("a -- it's; here\n; b") == ("a -- it's; here", " b")
    assert cli.split_statement("a /* ; ' */ - 1; b") == ("a /* ; ' */ - 1", " b")
    assert cli.split_statement("a /* ;") == (None, "a /* ;")
    assert cli.split_statement('"x;" ; c') == ('"x;"', " c")


def test_large_results_are_refused_whole(spark):
    frame = spark.range(50)
    assert answer(frame, "SELECT id FROM t", 50)["rowCount"] == 50
    with pytest.raises(SqlError, match="over 49 rows"):
        answer(frame, "SELECT id FROM t", 49)


def test_table_exists(spark, tmp_path):
    assert not table_exists(spark, str(tmp_path / "t"))
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert table_exists(spark, f"file://{tmp_path}/t")


def test_json_errors(url):
    try:
        urllib.request.urlopen(urllib.request.Request(f"{url}/query", b"SELECT 99999999999999999999 FROM t"))
    except urllib.error.HTTPError as e:
        assert e.code == 400 and "out of range" in json.load(e)["error"]
