"""Lines of remote or local files by byte ranges, numbered, from after a given line on.

A data source for Spark. A first pass counts the lines that begin in every byte range of the files, each range
in a task of its own; these counts number the lines, and tell the ranges that end before the line after which to
start, which aren't read again. A line belongs to the range that it begins in, and its task reads on until its end. A
broken connection goes on from the byte where it broke.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources.lines import allowed_url

#: Bytes of a range, and of a block that is read at once; times that a broken read is taken up again.
RANGE_BYTES, BLOCK_BYTES, TRIES = 64 << 20, 1 << 20, 3
#: Bytes that are read at once beyond a range's end, for the rest of its last line.
TAIL_BYTES = 16 << 10


def _remote(url: str) -> bool:
    return urlparse(url).scheme in ("http", "https")


def _opened(url: str, start: int):
    if _remote(url):
        return urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={start}-"}), timeout=60)
    from pyarrow import fs

    # Hadoop writes local paths with one slash.
    local = url.removeprefix("file:") if url.startswith("file:/") and not url.startswith("file://") else url
    store, path = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
    stream = store.open_input_file(path)
    stream.seek(start)
    return stream


def size_of(url: str) -> int:
    if _remote(url):
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as answer:
            return int(answer.headers["Content-Length"])
    with _opened(url, 0) as stream:
        return stream.size()


def blocks(url: str, start: int, size: int, end: int | None = None) -> Iterator[bytes]:
    """Bytes from ``start`` to the file's end, less at once beyond ``end``; a read that breaks goes on where it stopped."""
    left, end = TRIES, size if end is None else end
    while start < size:
        try:
            with _opened(url, start) as stream:
                while start < size:
                    block = stream.read(min(BLOCK_BYTES, size - start, end - start if start < end else TAIL_BYTES))
                    if not block:
                        raise OSError(f"{url} ended at byte {start} of {size}")
                    start, left = start + len(block), TRIES
                    yield block
        except OSError:
            left -= 1
            if left < 0:
                raise


def lines_in(url: str, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that begin in bytes ``start`` to ``end``, without their line ends."""
    # The byte before tells whether a line begins at the first one.
    at, skipping, rest = max(0, start - 1), start > 0, b""
    for block in blocks(url, at, size, end):
        # Lines are cut by their places, as what is left would be copied for each.
        rest, here = rest + block, 0
        while (cut := rest.find(b"\n", here)) >= 0:
            if not skipping:
                yield rest[here:cut]
            skipping, at, here = False, at + cut + 1 - here, cut + 1
            if at >= end:
                return
        rest = rest[here:]
        if skipping:
            at, rest = at + len(rest), b""
            if at >= end:
                return
    if rest and not skipping:
        yield rest


class _Range(InputPartition):
    def __init__(self, url: str, start: int, end: int, size: int, first: int):
        super().__init__((url, start))
        self.url, self.start, self.end, self.size, self.first = url, start, end, size, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = json.loads(options["ranges"])
        self.after, self.counting = int(options.get("after", 0)), options["mode"] == "count"

    def partitions(self) -> list[_Range]:
        return [_Range(*r) for r in self.ranges]

    def read(self, part: _Range):
        if self.counting:
            yield part.url, part.start, sum(1 for _ in lines_in(part.url, part.start, part.end, part.size)), None
            return
        for number, line in enumerate(lines_in(part.url, part.start, part.end, part.size), part.first):
            if number > self.after and line.strip():
                yield part.url, part.start, number, line.removesuffix(b"\r").decode("utf-8", "replace")


class NumberedLines(DataSource):
    """(url, start, line_no, line); only :func:`read_numbered` gives its options."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "url string, start long, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_numbered(spark: SparkSession, urls: list[str], after: int = 0, hosts: list[str] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(url, line_no, line) of all lines after line ``after`` of each file; line_no counts from 1, blank lines too.

    Blank lines themselves are left out. ``hosts``, if any, are those that remote files may come from.
    """
    refused = [u for u in urls if not allowed_url(u, list(hosts), local=not _remote(u))]
    if refused:
        raise ValueError(f"not an allowed source: {refused[0]}")
    spark.dataSource.register(NumberedLines)
    sizes = {u: size_of(u) for u in urls}
    ranges = [(u, s, min(s + range_bytes, sizes[u]), sizes[u], 0) for u in urls for s in range(0, sizes[u], range_bytes)]
    load = lambda mode, chosen: spark.read.format("numbered_lines").options(mode=mode, after=str(after), ranges=json.dumps(chosen)).load()
    counted = {(r["url"], r["start"]): r["line_no"] for r in load("count", ranges).collect()} if len(ranges) > len(sizes) or after else {}
    chosen, before = [], {}
    for url, start, end, size, _ in ranges:
        first = before.get(url, 0) + 1
        before[url] = first - 1 + counted.get((url, start), 0)
        if not counted or before[url] > after:
            chosen.append((url, start, end, size, first))
    if not chosen:
        return spark.createDataFrame([], "url string, line_no long, line string")
    return load("read", chosen).select("url", "line_no", F.col("line"))
