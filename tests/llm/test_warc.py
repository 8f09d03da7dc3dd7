"""Archives: written, read back, and merged, against a plain computation."""

import base64
import glob
import gzip
import hashlib
import random
from itertools import count

import pytest

from tallybook.llm import warc

SCHEMA = "page_id long, url string, html string, row int, first string, value string, size int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "v", 2) for r in rows], SCHEMA).repartition(4)


def pages():
    rng = random.Random(1)
    urls = ["http://www.b.example/x?z=1&a=2#f", "https://a.b.example:8080/", "HTTP://B.example:80/x?a=2&z=1", "not a url", "http://[bad/", None, ""]
    texts = [None, "", "same", "é🙂" * 50, "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nend", "\r\n\r\n", "x" * 300_000, "a\0b"]
    rows = [(i, rng.choice(urls), rng.choice(texts)) for i in range(60)]
    rows += [(100 + i, f"http://c.example/{i % 7}/ü path\r\nX: 1", f"page {i}") for i in range(60)]
    return [*rows, (None, urls[0], "same"), (None, None, "only here"), (-5, urls[1], "below zero"), (59, "http://again.example", rows[59][2]), (160, "http://c.example/", "page 3")]


def expected(rows):
    """Without rows that repeat an id, whose roles may be dealt either way."""
    payloads = {}
    for page, _, html in rows:
        payloads.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = max((p for p in payloads[html or ""] if p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if page == first else "revisit", None if page == first else first))
    return out


def got(history):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in history.orderBy("place").collect()]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    rows = [r for r in pages() if r[1] != "http://again.example"]
    folder = warc.write_archives(table(spark, rows), compression=compression)
    history = warc.histories(warc.read_runs(spark, folder))
    assert sorted(got(history), key=repr) == sorted(expected(rows), key=repr)
    lines = history.orderBy("place").collect()
    assert [r.place for r in lines] == list(range(len(rows)))
    assert [r.key for r in lines] == sorted(r.key for r in lines)
    keys = {r.url: r.key.split(" ")[0] for r in lines}
    assert keys["http://www.b.example/x?z=1&a=2#f"] == keys["HTTP://B.example:80/x?a=2&z=1"] == "example,b)/x?a=2&z=1"
    assert keys["https://a.b.example:8080/"] == "example,b,a:8080)/" and keys["not%20a%20url"] == "not%20a%20url"
    unpack = gzip.decompress if compression == "gzip" else bytes
    files = {f.rpartition("/")[2]: unpack(open(f, "rb").read()) for f in glob.glob(f"{folder}/part-*")}
    for r in lines:  # the index leads to the record
        record = files[r.file][r.offset : r.offset + r.length]
        assert record.startswith(warc.VERSION) and record.endswith(warc.END) and r.payload_digest.encode() in record
    assert warc.index_lines(history).count() == len(rows)


def test_one_response_among_repeated_ids(spark):
    rows = [(7, "u", "t")] * 5 + [(3, "v", "t"), (None, "w", "t")]
    found = got(warc.histories(warc.read_runs(spark, warc.write_archives(table(spark, rows)))))
    assert sorted((r[0] or 0, r[3], r[4] or 0) for r in found) == [(0, "revisit", 7), (3, "revisit", 7), (7, "response", 0)] + [(7, "revisit", 7)] * 4


def test_small_payloads_are_responses(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    found = got(warc.histories(warc.read_runs(spark, warc.write_archives(table(spark, rows), least=4))))
    assert sorted((r[0], r[3]) for r in found) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_merge_in_passes_and_spans(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100)
    rows = [(i, f"http://h{i % 5}.example/{i * 7919 % 400}", f"text {i % 300}") for i in range(400)] + [(1000 + i, "http://hot.example/", "hot") for i in range(300)]
    folder = warc.write_archives(table(spark, rows))
    runs = warc.read_runs(spark, folder, block=5)
    many = runs.selectExpr("run * 10 + part % 10 as run", "part", "captures")  # more runs than tasks; a run's parts stay in order
    for fan_in, span_rows in ((256, 20_000), (3, 40), (2, 1_000)):
        history = warc.histories(many, fan_in=fan_in, span_rows=span_rows, block=4)
        assert [r.key for r in history.orderBy("place").collect()] == sorted(r.key for r in history.collect())
        assert [r.place for r in history.orderBy("place").collect()] == list(range(700))
        assert sorted(got(history), key=repr) == sorted(expected(rows), key=repr)


def test_empty(spark):
    assert warc.histories(warc.read_runs(spark, warc.write_archives(table(spark, [])))).isEmpty()


def test_loser_tree_holds_one_block_of_each_run():
    rng = random.Random(5)
    for runs in (1, 2, 3, 7, 16):
        sources, serial = [], count()
        for run in range(runs):
            keys = sorted(f"{rng.randrange(50):03d} {next(serial):05d}" for _ in range(rng.randrange(0, 40)))
            sources.append([keys[i : i + 4] for i in range(0, len(keys), 4)])
        blocks = [(part[i - 1][-1] if i else "", run, [{"key": k} for k in part[i]]) for run, part in enumerate(sources) for i in range(len(part))]
        out = [c["key"] for c in warc.merged(iter(sorted(blocks, key=lambda b: b[:2])))]
        assert out == sorted(k for part in sources for b in part for k in b)


def test_a_broken_payload_is_found():
    with pytest.raises(ValueError):
        record = warc.record(warc.record_id(1, 2), b"u", "2024-01-01T00:00:00Z", b"payload", None) + warc.END
        (at, length, fields, block), = warc.records(__import__("io").BytesIO(record.replace(b"payload", b"PAYLOAD")))
        warc.capture("f", at, length, fields, block)
