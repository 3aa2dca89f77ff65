"""Questions over HTTP: GET /health, POST /ask with session_id and query (or user_query)."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from millrace.plans.ask import Engine

#: Bytes of a request that are read.
MOST_BYTES = 1 << 20


def serve(spark: SparkSession, engine: Engine, store: str, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that answers with the engine and keeps sessions under ``store``; the caller runs ``serve_forever``. Questions run as jobs of one session side by side; those of one session should come one after the other."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - named by the base class
            if self.path == "/health":
                self._send(200, {"status": "ok", "spark": spark.version})
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/ask":
                return self._send(404, {"detail": "not found"})
            try:
                body = json.loads(self.rfile.read(min(int(self.headers.get("Content-Length", 0)), MOST_BYTES)))
                session_id, query = str(body["session_id"]).strip(), str(body.get("query") or body.get("user_query") or "").strip()
                if not session_id or not query:
                    raise ValueError
            except (ValueError, KeyError, TypeError, AttributeError):
                return self._send(422, {"detail": "session_id and query (or user_query) must not be empty"})
            try:
                row = engine.ask_in_session(spark, store, session_id, query, body.get("region")).toJSON().first()
            except Exception as e:  # noqa: BLE001 - one question must not end the service
                return self._send(500, {"detail": f"{type(e).__name__}: {e}"[:500]})
            self._send(200, json.loads(row))

        def log_message(self, *args) -> None:
            """Nothing is logged by default."""

    return ThreadingHTTPServer((host, port), Handler)
