"""A small HTTP endpoint: ``python -m vellumflow.serve [PORT]``; GET /health, POST /analyze with ``{"text": ...}``.

For single requests, each of which is a small Spark job of the session; tables
belong to ``entities.analyze``. A body of more than 1 MiB is answered with 413.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from vellumflow.api import analyze_texts, health

LIMIT = 1 << 20  # most bytes of a request


def answer(spark: SparkSession, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and document of a request: 422 for a blank or missing text, 404 and 405 for what there isn't."""
    if path not in ("/health", "/analyze"):
        return 404, {"detail": "not found"}
    if (method, path) == ("GET", "/health"):
        return 200, health()
    if (method, path) != ("POST", "/analyze"):
        return 405, {"detail": "method not allowed"}
    try:
        text = json.loads(body)["text"]
        return 200, analyze_texts(spark, [text])[0]
    except (ValueError, KeyError, TypeError) as e:
        return 422, {"detail": str(e)}


def server(spark: SparkSession, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, document = (413, {"detail": "too large"}) if size > LIMIT else answer(spark, self.command, self.path, self.rfile.read(size))
            raw = json.dumps(document, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


if __name__ == "__main__":
    server(SparkSession.builder.appName("vellumflow").getOrCreate(), int((sys.argv[1:] or ["8000"])[0])).serve_forever()
