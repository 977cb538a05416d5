"""HTTP service over one table: GET /health, GET /schema, POST /query, GET /."""

from __future__ import annotations

import argparse
import datetime
import decimal
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from granary.plans.planner import plan
from granary.session import session
from granary.sources.tables import describe, open_table, table_exists, table_name, type_name
from granary.sources.tsv import convert
from granary.sql.errors import SqlError

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>granary</title>
<style>body{font-family:sans-serif;margin:2em}textarea{width:100%;height:7em;font-family:monospace}table{border-collapse:collapse;margin-top:1em}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}</style></head>
<body><h1 id="name"></h1><p id="columns"></p><textarea id="sql" placeholder="SELECT ... (Ctrl-Enter runs it)"></textarea><p id="note"></p><table id="rows"></table>
<script>
const $ = id => document.getElementById(id);
fetch('/schema').then(r => r.json()).then(s => { $('name').textContent = s.name + ', ' + s.rowCount + ' rows'; $('columns').textContent = s.columns.map(c => c.name + ' ' + c.type).join(', '); });
$('sql').addEventListener('keydown', async e => {
  if (e.key !== 'Enter' || !(e.ctrlKey || e.metaKey)) return;
  const r = await (await fetch('/query', {method: 'POST', body: $('sql').value})).json();
  $('rows').replaceChildren();
  if (r.error) { $('note').textContent = r.error; return; }
  $('note').textContent = r.rowCount + ' rows in ' + r.elapsedMs + ' ms';
  const row = (cells, tag) => { const tr = $('rows').insertRow(); for (const c of cells) { const x = document.createElement(tag); x.textContent = c === null ? '\\u2205' : c; tr.append(x); } };
  row(r.columns.map(c => c.name), 'th'); r.rows.forEach(x => row(x, 'td'));
});
</script></body></html>"""


def to_json(v: object) -> object:
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v != v or v in (float("inf"), float("-inf")):
        return None
    return v.hex() if isinstance(v, (bytes, bytearray)) else v


#: Most rows of a response; a result with more is refused, not cut.
MAX_ROWS = 1_000_000


def answer(frame: DataFrame, sql: str, most: int = MAX_ROWS) -> dict:
    """Runs a statement and gathers its rows, at most `most`; a larger result is an error that asks for a LIMIT."""
    began = time.perf_counter_ns()
    out = plan(sql, frame)
    found = out.limit(most + 1).collect()
    if len(found) > most:
        raise SqlError(f"the result has over {most} rows; add a LIMIT")
    rows = [[to_json(v) for v in r] for r in found]
    took = time.perf_counter_ns() - began
    columns = [{"name": f.name, "type": type_name(f.dataType)} for f in out.schema.fields]
    return {"columns": columns, "rows": rows, "rowCount": len(rows), "elapsedMs": took // 1_000_000, "elapsedNanos": took}


def make_server(frame: DataFrame, name: str, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    count: list[int] = []

    def rows() -> int:
        if not count:
            count.append(frame.count())
        return count[0]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            pass

        def send(self, status: int, body: object, kind: str = "application/json; charset=utf-8") -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def serve(self) -> None:
            path, method = self.path.partition("?")[0], self.command
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            if path == "/health":
                self.send(200, {"status": "ok", "rowCount": rows()})
            elif path in ("/schema", "/query") and method != ("GET" if path == "/schema" else "POST"):
                self.send(405, {"error": "method not allowed"})
            elif path == "/schema":
                self.send(200, describe(frame, name) | {"rowCount": rows()})
            elif path == "/query":
                try:
                    self.send(200, answer(frame, body))
                except (SqlError, AnalysisException) as e:
                    self.send(400, {"error": str(e)})
                except Exception as e:  # noqa: BLE001  the client is told; the service goes on
                    self.send(500, {"error": str(e).split("\n")[0]})
            elif path in ("/", "/index.html") and method == "GET":
                self.send(200, PAGE, "text/html; charset=utf-8")
            else:
                self.send(404, {"error": "not found"})

        do_GET = do_POST = do_PUT = do_DELETE = serve

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="granary.server", description="Serve one table over HTTP.")
    p.add_argument("--data-dir", required=True, help="Parquet table; made from --tsv if it is not there")
    p.add_argument("--tsv")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--header", action="store_true", help="the TSV's first line names the columns")
    p.add_argument("--column-names", help="comma-separated")
    args = p.parse_args(argv)
    spark = session()
    if args.tsv and not table_exists(spark, args.data_dir):
        convert(spark, args.tsv, args.data_dir, args.header, args.column_names.split(",") if args.column_names else None)
    with make_server(open_table(spark, args.data_dir), table_name(args.data_dir), args.port) as server:
        print(f"http://127.0.0.1:{server.server_port}", flush=True)
        server.serve_forever()


if __name__ == "__main__":
    main()
