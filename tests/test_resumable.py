"""Numbered lines over many ranges and resumptions, from files and over HTTP with broken connections."""

from __future__ import annotations

import random
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quillspark.sources import resumable


def some_file(seed, n):
    rng = random.Random(seed)
    lines = [rng.choice(["", " ", "é" * rng.randint(1, 30), "x" * rng.randint(1, 90), "a\rb"]) for _ in range(n)]
    return lines, "\n".join(lines).encode() + rng.choice([b"", b"\n"])


@pytest.fixture
def server():
    """Serves bytes with ranges; every third answer breaks after some bytes."""
    files, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(files[self.path])))
            self.end_headers()

        def do_GET(self):
            start = int(re.match(r"bytes=(\d+)-", self.headers["Range"])[1])
            body = files[self.path][start:]
            asked.append(start)
            self.send_response(206)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[: max(1, len(body) // 2)] if len(asked) % 3 == 0 else body)

        def log_message(self, *args):
            pass

    served = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}", files, asked
    served.shutdown()


def test_lines_of_any_ranges_are_the_files(tmp_path):
    for seed in range(40):
        lines, body = some_file(seed, random.Random(seed).randint(0, 25))
        path = tmp_path / f"f{seed}"
        path.write_bytes(body)
        for step in (1, 7, 64, 10_000):
            found = [x for s in range(0, len(body), step) for x in resumable.lines_in(str(path), s, min(s + step, len(body)), len(body))]
            assert found == body.decode().removesuffix("\n").encode().split(b"\n") if body else found == []


def test_numbers_after_a_line_over_files_and_ranges(spark, tmp_path):
    wanted = {}
    for name in ("one", "two"):
        lines, body = some_file(len(name) + ord(name[0]), 120)
        (tmp_path / name).write_bytes(body)
        wanted[name] = {(i, x.removesuffix("\r")) for i, x in enumerate(lines, 1) if x.strip()}
    urls = [str(tmp_path / n) for n in wanted]
    for after, step in ((0, 300), (37, 300), (37, 10**6), (500, 300)):
        found = resumable.read_numbered(spark, urls, after, range_bytes=step).collect()
        assert {(r["url"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in found} == {(n, i, x) for n, rows in wanted.items() for i, x in rows if i > after}


def test_http_goes_on_after_breaks_and_skips_what_was_read(spark, server):
    base, files, asked = server
    lines, body = some_file(3, 400)
    files["/a.jsonl"] = body
    found = resumable.read_numbered(spark, [f"{base}/a.jsonl"], 250, ["127.0.0.1"], range_bytes=2000).collect()
    assert {(r["line_no"], r["line"]) for r in found} == {(i, x) for i, x in enumerate(lines, 1) if x.strip() and i > 250}
    with pytest.raises(ValueError):
        resumable.read_numbered(spark, [f"{base}/a.jsonl"], hosts=["example.org"])


def test_a_range_reads_little_beyond_its_end(tmp_path, monkeypatch):
    path = tmp_path / "long.txt"
    path.write_bytes(b"".join(b"%d words of a line\n" % i for i in range(100_000)))
    size, read, opened = path.stat().st_size, [], resumable._opened

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, n):
            read.append(n)
            return self.stream.read(n)

    monkeypatch.setattr(resumable, "_opened", lambda url, start: Counting(opened(url, start)))
    found = [x for s in range(0, size, 50_000) for x in resumable.lines_in(str(path), s, min(s + 50_000, size), size)]
    assert found == path.read_bytes().splitlines() and sum(read) < 2 * size
