"""Small HTTP servers on the driver for queries and tests: a paged search API and files by ranges.

They listen on the driver's host, where executors reach them too; one server serves all calls for the same content, and all
stop with the process.
"""

from __future__ import annotations

import atexit
import json
import threading
from functools import lru_cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from rasterspark.sources.bytesource import open_source


def driver_host(spark: SparkSession) -> str:
    return spark.sparkContext.getConf().get("spark.driver.host") or "127.0.0.1"


def _running(handler: type[BaseHTTPRequestHandler], host: str) -> ThreadingHTTPServer:
    server = ThreadingHTTPServer((host, 0), handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    atexit.register(server.shutdown)
    return server


class _Quiet(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def answer(self, status: int, data: bytes) -> None:
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_) -> None:
        pass


@lru_cache(maxsize=16)
def search_server(items: int, page: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A search API at /search with `items` items, `page` on a page unless the request says otherwise."""

    class Handler(_Quiet):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            first = int(body.get("token", 0))
            size = int(body.get("limit", page))
            known = [] if body.get("collections") == ["empty"] else range(first, min(first + size, items))
            document = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"scene-{i}", "collection": (body.get("collections") or ["all"])[0], "assets": {"B04": {"href": f"scene-{i}.tif"}}} for i in known]}
            if known and first + size < items:
                document["links"] = [{"rel": "next", "href": "/search", "method": "POST", "merge": True, "body": {"token": first + size}}]
            self.answer(200 if self.path == "/search" else 404, json.dumps(document).encode())

    return _running(Handler, host)


@lru_cache(maxsize=16)
def file_server(path: str, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """One file at /file, by ranges; what follows a question mark is not looked at."""
    source = open_source(path)

    class Handler(_Quiet):
        def do_GET(self):  # noqa: N802
            if urlsplit(self.path).path != "/file":
                self.answer(404, b"")
                return
            if not (wanted := self.headers.get("Range")):
                self.answer(200, source.read_all())
                return
            first, last = map(int, wanted.removeprefix("bytes=").split("-"))
            try:
                data = source.read(first, last + 1)
            except EOFError:
                data = b""
            self.answer(206 if data else 416, data)

    return _running(Handler, host)


def address(server: ThreadingHTTPServer, path: str) -> str:
    return f"http://{server.server_address[0]}:{server.server_port}{path}"
