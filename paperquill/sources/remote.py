"""Fetching over HTTP from tasks: tries again, reads ranges, and stores files so that no half of one is seen.

How a request is made is a parameter (`get`), so tests and other transports need no network.
"""

from __future__ import annotations

import io
import posixpath
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tries of a request and the seconds by which each wait grows; bytes of a block; limits of a remote file.
TRIES, WAIT, BLOCK, MOST_BYTES, MOST_SECONDS = 3, 2.0, 1 << 16, 40 << 20, 180.0


@dataclass
class Response:
    status: int
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)


def http_get(url: str, headers: dict[str, str], timeout: float = 60) -> Response:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        return Response(r.status, r.read(), {k.lower(): v for k, v in r.headers.items()})


def retrying(get: Callable[..., Response], tries: int = TRIES, wait: float = WAIT, delay: float = 0.0, sleep: Callable = time.sleep) -> Callable[..., Response | None]:
    """get with a pause before each try and one that grows after each failure; None when all tries have failed."""

    def ask(url: str, headers: dict[str, str] | None = None) -> Response | None:
        for k in range(1, tries + 1):
            sleep(delay)
            try:
                got = get(url, headers or {})
                if got.status < 400:
                    return got
            except Exception:  # whatever the transport raises
                pass
            sleep(k * wait)
        return None

    return ask


class Refused(Exception):
    """A remote file that is not to be read on: no file, too large, too slow, or without ranges half way."""


class RangeReader(io.RawIOBase):
    """A seekable file of blocks that are asked for by range when they are read, each once.

    A server that ignores the first range has sent the whole file, which is kept if it isn't too large.
    """

    def __init__(self, url: str, get: Callable[..., Response], block: int = BLOCK, most_bytes: int = MOST_BYTES, most_seconds: float = MOST_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.url, self.get, self.block, self.at, self.clock = url, get, block, 0, clock
        self.until, self.held, self.fetched = clock() + most_seconds, {}, 0
        first = get(url, {"Range": "bytes=0-0"})
        if "html" in first.headers.get("content-type", "").lower():
            raise Refused("a web page, not a file")
        total = first.headers.get("content-range", "").rpartition("/")[2]
        if first.status == 206 and total.isdigit():
            self.size = int(total)
            return
        self.size = self.fetched = len(first.body)
        if self.size > most_bytes:
            raise Refused(f"larger than {most_bytes >> 20} MB")
        self.held = {i: first.body[i * block : (i + 1) * block] for i in range(-(-self.size // block))}

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def _part(self, i: int) -> bytes:
        if self.clock() > self.until:
            raise Refused("too slow")
        if i not in self.held:
            last = min((i + 1) * self.block, self.size) - 1
            got = self.get(self.url, {"Range": f"bytes={i * self.block}-{last}"})
            if got.status != 206:
                raise Refused("no more ranges")
            self.held[i] = got.body
            self.fetched += len(got.body)
        return self.held[i]

    def read(self, n: int | None = -1) -> bytes:
        left = max(0, self.size - self.at)
        left = left if n is None or n < 0 else min(n, left)
        stop, out = self.at + left, bytearray()
        while self.at < stop:
            i, skip = divmod(self.at, self.block)
            piece = self._part(i)[skip : skip + stop - self.at]
            if not piece:
                break
            out += piece
            self.at += len(piece)
        return bytes(out)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at


def fetch(urls: DataFrame, make: Callable[[], Callable[..., Response | None]], url: str = "url") -> DataFrame:
    """urls with body (binary) and error: 'failed' where all tries did, null otherwise. Each task makes one getter."""
    schema = urls.withColumn("body", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make()
        for pdf in frames:
            got = [get(u) if u else None for u in pdf[url]]
            yield pdf.assign(body=[None if r is None else r.body for r in got], error=[None if r is not None else "failed" for r in got])

    return urls.mapInPandas(run, schema)


def store_files(files: DataFrame, folder: str, begins: bytes = b"%PDF-", path: str = "local_path", content: str = "content") -> DataFrame:
    """path and error of files (path, content) that were written below a folder which driver and executors share.

    A file gets its name when it is complete: it is written under another one first, and repeated tasks do no harm. One
    that doesn't begin as it should is not written, its error is 'not a valid file'; 'nothing to store' for null content.
    """

    def one(name: str, data: bytes | None) -> str | None:
        if data is None or name is None:
            return "nothing to store"
        if not bytes(data).startswith(begins):
            return "not a valid file"
        store, root = fs.FileSystem.from_uri(folder)
        whole = posixpath.join(root, name)
        part = f"{whole}.{uuid.uuid4().hex}.part"
        store.create_dir(posixpath.dirname(whole))
        with store.open_output_stream(part) as out:
            out.write(bytes(data))
        store.move(part, whole)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({path: pdf[path], "error": pd.Series([one(p, c) for p, c in zip(pdf[path], pdf[content])], index=pdf.index, dtype=object)})

    return files.select(path, content).mapInPandas(run, f"`{path}` string, error string")
