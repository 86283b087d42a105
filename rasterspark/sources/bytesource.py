"""Byte ranges of files: local paths, HTTP and every store that pyarrow opens by URI.

A range that ends beyond the file is cut at its end; one that starts there, or is reversed, is an error.
"""

from __future__ import annotations

import http.client
import os
import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow.fs as pafs

MERGE_GAP = 16_384  # ranges closer than this are fetched together


class SourceError(OSError):
    """A file cannot be opened or read; the message has its path."""


class ByteSource:
    """read(start, end) returns bytes [start, min(end, size))."""

    def read(self, start: int, end: int) -> bytes:
        raise NotImplementedError

    def read_all(self) -> bytes:
        """The whole file, by ranges that grow."""
        out, step = b"", 65_536
        while True:
            try:
                part = self.read(len(out), len(out) + step)
            except EOFError:
                return out
            out += part
            if len(part) < step:
                return out
            step *= 4

    def read_many(self, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        """Several ranges; neighbours are fetched together."""
        groups: list[tuple[int, int, list[int]]] = []
        for i in sorted(range(len(ranges)), key=lambda i: ranges[i]):
            a, b = ranges[i]
            if groups and a <= groups[-1][1] + MERGE_GAP:
                first, last, members = groups[-1]
                groups[-1] = (first, max(last, b), [*members, i])
            else:
                groups.append((a, b, [i]))
        out: list[bytes] = [b""] * len(ranges)
        for (first, _, members), data in zip(groups, self.each([(a, b) for a, b, _ in groups]), strict=True):
            for i in members:
                a, b = ranges[i]
                out[i] = data[a - first : b - first]
        return out

    def each(self, ranges: Sequence[tuple[int, int]]) -> Iterator[bytes]:
        """The ranges one by one; remote sources fetch several at a time."""
        return (self.read(a, b) for a, b in ranges)


def _checked(start: int, end: int) -> None:
    if start < 0 or end < start:
        raise ValueError(f"reversed byte range {start}..{end}")


class BytesSource(ByteSource):
    """A file's content held in memory, as of Spark's binaryFile."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, start: int, end: int) -> bytes:
        _checked(start, end)
        if start >= len(self.data):
            raise EOFError(f"range starts at {start}, beyond the end")
        return bytes(self.data[start:end])


class LocalSource(ByteSource):
    def __init__(self, path: str):
        try:
            self.file = open(path, "rb")  # noqa: SIM115 - lives as long as the source
        except OSError as e:
            raise SourceError(f"cannot open '{path}': {e}") from e
        self.size = os.fstat(self.file.fileno()).st_size

    def read(self, start: int, end: int) -> bytes:
        _checked(start, end)
        if start >= self.size:
            raise EOFError(f"range starts at {start}, beyond the end")
        return os.pread(self.file.fileno(), end - start, start)


class StoreSource(ByteSource):
    """s3://, gs://, hdfs://, file:// and other URIs that pyarrow knows."""

    def __init__(self, uri: str):
        try:
            fs, path = pafs.FileSystem.from_uri(uri)
            self.file = fs.open_input_file(path)
        except (OSError, ValueError) as e:
            raise SourceError(f"cannot open '{uri}': {e}") from e
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        _checked(start, end)
        if start >= self.size:
            raise EOFError(f"range starts at {start}, beyond the end")
        return self.file.read_at(min(end, self.size) - start, start)


def concurrently(run: Callable, items: Sequence) -> Iterator:
    """run(item) of all items in their order, COG_FETCH_CONCURRENCY (16) at a time; the first error is raised.

    Inside a thread of this pool the items follow each other, so that no thread waits for one that never comes.
    """
    if len(items) < 2 or getattr(_inside, "pool", False):
        return map(run, items)
    global _threads
    if _threads is None or _threads[0] != os.getpid():  # workers are forked
        _threads = (os.getpid(), ThreadPoolExecutor(max(1, int(os.environ.get("COG_FETCH_CONCURRENCY", "16") or 16)), initializer=lambda: setattr(_inside, "pool", True)))
    return _threads[1].map(run, items)


_threads: tuple[int, ThreadPoolExecutor] | None = None
_inside = threading.local()


class HttpSource(ByteSource):
    """Range requests over connections that are kept and shared by origin within a thread."""

    _kept = threading.local()

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout = url, timeout

    def _connection(self, origin: tuple[str, str], fresh: bool):
        pool = self._kept.__dict__.setdefault("pool", {})
        if fresh or origin not in pool:
            if len(pool) >= 32:
                pool.clear()
            kind = http.client.HTTPSConnection if origin[0] == "https" else http.client.HTTPConnection
            pool[origin] = kind(origin[1], timeout=self.timeout)
        return pool[origin]

    def request(self, method: str, headers: dict[str, str], body: bytes | None = None) -> tuple[int, bytes]:
        url = self.url
        for _ in range(5):
            at = urlsplit(url)
            target = (at.path or "/") + (f"?{at.query}" if at.query else "")
            for fresh in (False, True):  # a kept connection may have been closed by the server
                connection = self._connection((at.scheme, at.netloc), fresh)
                try:
                    connection.request(method, target, body=body, headers=headers)
                    answer = connection.getresponse()
                    data = answer.read()
                    break
                except (OSError, http.client.HTTPException) as e:
                    if fresh:
                        raise SourceError(f"cannot open '{self.url}': {e}") from e
            if answer.status in (301, 302, 303, 307, 308) and answer.getheader("Location"):
                url = urljoin(url, answer.getheader("Location"))
                continue
            return answer.status, data
        raise SourceError(f"cannot open '{self.url}': too many redirects")

    def each(self, ranges: Sequence[tuple[int, int]]) -> Iterator[bytes]:
        return concurrently(lambda r: self.read(*r), ranges)

    def read(self, start: int, end: int) -> bytes:
        _checked(start, end)
        if start == end:
            return b""
        status, data = self.request("GET", {"Range": f"bytes={start}-{end - 1}"})
        if status == 206:
            return data
        if status == 200:  # the server knows no ranges
            if start >= len(data):
                raise EOFError(f"range starts at {start}, beyond the end")
            return data[start:end]
        if status == 416:
            raise EOFError(f"range starts at {start}, beyond the end")
        raise SourceError(f"'{self.url}': HTTP status {status}")


class CountingSource(ByteSource):
    """Counts the fetches and bytes of another source."""

    def __init__(self, inner: ByteSource):
        self.inner, self.fetches, self.bytes = inner, 0, 0

    def each(self, ranges: Sequence[tuple[int, int]]) -> Iterator[bytes]:
        for data in self.inner.each(ranges):
            self.fetches += 1
            self.bytes += len(data)
            yield data

    def read(self, start: int, end: int) -> bytes:
        data = self.inner.read(start, end)
        self.fetches += 1
        self.bytes += len(data)
        return data


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def open_source(path: str, io: str = "auto") -> ByteSource:
    """The source for a path or URI; io forces `file`, `object_store` or `http`."""
    if path.startswith("file:/"):  # Spark writes local paths with one slash or three
        path = unquote(path.removeprefix("file:").replace("///", "/", 1))
    scheme = path.split("://", 1)[0].lower() if "://" in path else ""
    if io not in ("auto", "file", "object_store", "http"):
        raise ValueError(f"unknown io '{io}': expected file|object_store|http|auto")
    if io == "file" or (io == "auto" and not scheme):
        return LocalSource(path)
    if io == "http" or (io == "auto" and scheme in ("http", "https")):
        return HttpSource(path)
    return StoreSource(path if scheme else "file://" + os.path.abspath(path))
