"""Web archives: pages written as WARC records, read back, and indexed by an external merge of sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, ship, staged, trimmed

# What the format's readers expect.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Seconds since 1970 of the first capture where a table holds no time.
_BEGIN = 1_704_067_200
#: Bit that marks a record of a page without an id; row numbers stay below it.
_NO_PAGE = 1 << 63
#: Bytes of payload an archive file should hold; a task reads one at a time.
FILE_BYTES = 8 << 20

CAPTURE = (
    "key string, file string, offset long, length long, page_id long, url string, timestamp string,"
    " payload_bytes long, payload_digest string, record_type string, refers_to long"
)
_CAPTURE = pa.struct(
    [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in CAPTURE.split(","))]
)


# --- records ---------------------------------------------------------------------------------------


def record_id(page_id: int | None, row: int) -> str:
    """A record's name: the page's id and the row's number, side by side in a UUID."""
    low = row | (_NO_PAGE if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=((page_id or 0) % (1 << 64)) << 64 | low)}>"


def page_of(name: str) -> int | None:
    both = uuid.UUID(name[1:-1].removeprefix("urn:uuid:")).int
    if both & _NO_PAGE:
        return None
    page = both >> 64
    return page - (1 << 64) if page >> 63 else page


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: bytes, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record without the two line ends that close it; a revisit leaves the payload out."""
    kind = b"revisit" if refers_to else b"response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not refers_to:
        block += payload
    head = [
        VERSION,
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: " + name.encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url),
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
    ]
    if refers_to:
        head += [b"WARC-Refers-To: " + refers_to.encode(), b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + END + block


def _headers(stream: io.BufferedIOBase) -> tuple[dict[bytes, bytes], int]:
    """Header fields up to the empty line, and the bytes they took."""
    fields, size = {}, 0
    while (line := stream.readline()).strip():
        size += len(line)
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    return fields, size + len(line)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Place, length, header fields and block of every record; places count unpacked bytes."""
    at = 0
    while line := stream.readline():
        if line.rstrip() != VERSION:
            raise ValueError(f"no record at {at}")
        fields, size = _headers(stream)
        block = stream.read(int(fields[b"content-length"]))
        if len(block) != int(fields[b"content-length"]) or stream.read(len(END)) != END:
            raise ValueError(f"the record at {at} is cut off")
        length = len(line) + size + len(block) + len(END)
        yield at, length, fields, block
        at += length


def url_key(url: str) -> str:
    """A sortable form: host from its last label on, then port, path and sorted query, all without
    scheme, fragment and a leading www. Text that is no URL stands for itself; no key holds a space."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        host = ""
    if not host:
        return url.replace(" ", "%20")
    plain = {"http": 80, "https": 443}.get(parts.scheme.lower())
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != plain else "")
    return f"{key}){parts.path or '/'}{'?' + query if query else ''}".replace(" ", "%20")


def capture(file: str, at: int, length: int, fields: dict[bytes, bytes], block: bytes) -> dict:
    """A line of the index; the payload of a response must have the digest its header tells."""
    text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
    inner = io.BytesIO(block)
    inner.readline()
    http, _ = _headers(inner)
    told, kind = text[b"warc-payload-digest"].removeprefix("sha1:"), text[b"warc-type"]
    if kind == "response" and digest(inner.read()) != told:
        raise ValueError(f"{file}: the payload at {at} does not have its digest")
    name, url = text[b"warc-record-id"], text[b"warc-target-uri"]
    stamp = re.sub(r"\D", "", text[b"warc-date"])[:14]
    return {
        "key": f"{url_key(url)} {stamp} {name}",
        "file": file,
        "offset": at,
        "length": length,
        "page_id": page_of(name),
        "url": url,
        "timestamp": stamp,
        "payload_bytes": int(http[b"content-length"]),
        "payload_digest": told,
        "record_type": kind,
        "refers_to": page_of(text[b"warc-refers-to"]) if b"warc-refers-to" in text else None,
    }


# --- writing ---------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None, *, captured: Column | None = None, least: int = 0, compression: str = "gzip") -> str:
    """Writes one record per row of page_id, url, html; returns the folder of the archives.

    Of the rows with one payload of at least `least` bytes, that with the largest page_id becomes a
    response and the others revisits of it; between rows that repeat that id, one is the response. Equal means an
    equal SHA-256 and length. The response of a payload is a sum combined on the map side; rows meet it
    in a join that adaptive execution splits where a payload is very frequent. With `compression`
    "none" the places in the index are those in the file; with "gzip" they count unpacked bytes.

    Null html is an empty payload, null url an empty one; a row without page_id has a record whose id
    tells so, and is response only where no equal row has an id. Control characters and spaces of a
    URL are percent-encoded. Other columns are ignored. An empty table gives a folder without records.
    A payload has to fit into memory.
    """
    spark = pages.sparkSession
    ship(spark)
    at = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    time = F.timestamp_seconds(F.lit(_BEGIN) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**8)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).cast("binary").alias("url"),
        F.date_format(F.to_utc_timestamp(time if captured is None else captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Staged, as a row's number has to be the same wherever it is asked for, also after a lost task.
    rows = staged(rows.withColumns({"sum": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")}))
    total = rows.agg(F.count("*"), F.sum("size")).first()
    per_file = max(1, FILE_BYTES * total[0] // max(total[1] or 0, 1))
    first = rows.groupBy("sum", "size").agg(F.max(F.struct("page_id", "row")).alias("first"))
    joined = rows.join(first, ["sum", "size"]).select("page_id", "row", "url", "date", "payload", "first.*").toDF(
        "page_id", "row", "url", "date", "payload", "first_page", "first_row"
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, row, url, date, payload, to_page, to_row in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                alone = row == to_row or len(payload) < least
                out.append(record(record_id(page, row), url, date, payload, None if alone else record_id(to_page, to_row)))
            yield pa.record_batch({"value": pa.array(out, pa.binary())})

    lines = joined.mapInArrow(trimmed(formatted), "value binary").select(F.col("value").cast("string").alias("value"))
    writer = lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file)
    writer.option("compression", compression).text(at)
    return at


# --- reading and merging ---------------------------------------------------------------------------


def read_runs(spark: SparkSession, folder: str, *, block: int = 256) -> DataFrame:
    """Sorted runs of captures, one for each task that reads archives, in blocks.

    Columns: run, part (block of the run), captures (sorted by key). A task reads one file at a time.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                file = path.as_py().rpartition("/")[2]
                raw = io.BytesIO(memoryview(content.as_buffer()))
                stream = gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw
                found.extend(capture(file, *r) for r in records(io.BufferedReader(stream) if file.endswith(".gz") else stream))
        found.sort(key=lambda c: c["key"])
        run = TaskContext.get().partitionId()
        for part, i in enumerate(range(0, len(found), block)):
            yield _block({"run": run, "part": part}, found[i : i + block])

    return files.mapInArrow(trimmed(indexed), f"run long, part long, captures array<struct<{_fields()}>>")


def _fields() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in CAPTURE.split(",")))


def _block(head: dict[str, object], captures: list[dict]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array([v]) for k, v in head.items()} | {"captures": pa.array([captures], pa.list_(_CAPTURE))})


@dataclass
class LoserTree:
    """The least of many sorted sources: inner nodes keep the loser of their match, so that
    a source that moves on plays only against the losers on its way to the root."""

    keys: list[str | None]  #: the key each source stands at; None: at its end

    def __post_init__(self) -> None:
        self.nodes: list[int] = [-1] * max(1, len(self.keys))
        for leaf in range(len(self.keys)):
            self.replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def replay(self, leaf: int) -> None:
        """Plays the matches of a source again: each at the start, then the last winner only."""
        node, winner = (leaf + len(self.keys)) // 2, leaf
        while node:
            if self.nodes[node] == -1:  # the first to come waits for its opponent
                self.nodes[node] = winner
                return
            if self._before(self.nodes[node], winner):
                winner, self.nodes[node] = self.nodes[node], winner
            node //= 2
        self.nodes[0] = winner

    @property
    def winner(self) -> int:
        return self.nodes[0]


def merged(blocks: Iterator[tuple[str, int, list[dict]]]) -> Iterator[dict]:
    """Captures of many runs in order of their keys.

    Blocks (needed, run, captures) come in the order in which a merge asks for them: first the first of each run
    (needed is ""), then every other by the last key of the block before it. So one block of each run
    is held, and a run that has used its block up finds its next one at the head of the input.
    """
    ahead = next(blocks, None)
    held: list[tuple[int, list[dict]]] = []
    while ahead and ahead[0] == "":
        held.append((ahead[1], ahead[2]))
        ahead = next(blocks, None)
    if not held:
        return
    place = [0] * len(held)
    tree = LoserTree([b[0]["key"] for _, b in held])
    while tree.keys[leaf := tree.winner] is not None:
        run, captures = held[leaf]
        yield captures[place[leaf]]
        place[leaf] += 1
        if place[leaf] == len(captures):
            if ahead and ahead[1] == run and ahead[0] == captures[-1]["key"]:
                held[leaf], place[leaf] = (run, ahead[2]), 0
                ahead = next(blocks, None)
            else:
                held[leaf], place[leaf] = (run, []), 0
        captures = held[leaf][1]
        tree.keys[leaf] = captures[place[leaf]]["key"] if captures else None
        tree.replay(leaf)
    if ahead:
        raise RuntimeError("a block came out of its turn")


def _merge_task(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the runs of each (span, into) of its sorted input to one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for i in range(len(b)) for row in b.slice(i, 1).to_pylist())
        ahead = next(rows, None)
        while ahead:
            here = ahead["span"], ahead["into"]

            def own() -> Iterator[tuple[str, int, list[dict]]]:
                nonlocal ahead
                while ahead and (ahead["span"], ahead["into"]) == here:  # noqa: B023
                    row, ahead = ahead, next(rows, None)
                    yield row["needed"], row["run"], row["captures"]

            out, part, needed = [], 0, ""
            for c in merged(own()):
                out.append(c)
                if len(out) == block:
                    yield _block({"span": here[0], "run": here[1], "part": part, "needed": needed}, out)
                    out, part, needed = [], part + 1, c["key"]
            if out:
                yield _block({"span": here[0], "run": here[1], "part": part, "needed": needed}, out)

    return run


def bounds(runs: DataFrame, spans: int, per_span: int = 32) -> list[str]:
    """Keys that cut the captures into about `spans` ranges of like size.

    Drawn from the first keys of at most about 2 * per_span * spans blocks, by a hash.
    """
    if spans < 2:
        return []
    firsts = runs.select(F.col("captures")[0]["key"].alias("key"))
    share = min(1.0, 2 * per_span * spans / max(1, firsts.count()))
    drawn = firsts.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000))
    keys = sorted(r.key for r in drawn.collect())
    return sorted({keys[len(keys) * i // spans] for i in range(1, spans)}) if keys else []


def histories(runs: DataFrame, *, span_rows: int = 20_000, most_spans: int = 4096, fan_in: int = 256, block: int = 256) -> DataFrame:
    """All captures in one order, by URL key, then time, then record: place (from 0) and the columns of CAPTURE.

    Sorted runs are cut at common keys into at most `most_spans` spans of about `span_rows` captures;
    the runs of each span are merged by a loser tree, at most `fan_in` at a time, in as many passes as
    that takes. A merge holds a block of `block` captures of each run, whatever the span's size: blocks
    are dealt in the order in which they run out. A URL that was captured very often lies in several
    spans, as keys end with the record. Each pass is staged. place goes through all spans; an empty index has no rows.
    """
    runs = staged(runs)
    n, last = runs.agg(F.sum(F.size("captures")), F.max("run")).first()
    cuts = bounds(runs, min(most_spans, math.ceil((n or 0) / span_rows)))
    cut_schema = f"span long, run long, part long, needed string, captures array<struct<{_fields()}>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                captures, at = row["captures"], 0
                keys = [c["key"] for c in captures]
                for span in range(bisect_right(cuts, keys[0]), len(cuts) + 1):
                    end = bisect_left(keys, cuts[span]) if span < len(cuts) else len(keys)
                    if end > at:
                        yield _block({"span": span, "run": row["run"], "part": row["part"], "needed": ""}, captures[at:end])
                        at = end
                    if at == len(keys):
                        break

    pieces = runs.mapInArrow(cut, cut_schema)
    left = (last or 0) + 1
    first = True
    while first or left > 1:
        if first:  # the block before, in its run and span, tells when a block is needed
            before = "lag(captures[size(captures) - 1].key) over (partition by span, run order by part)"
            pieces = pieces.withColumn("needed", F.expr(f"coalesce({before}, '')"))
        left, first = math.ceil(left / fan_in), False
        dealt = pieces.withColumn("into", F.expr(f"run div {fan_in}")).repartition("span", "into")
        ordered = dealt.sortWithinPartitions("span", "into", "needed", "run").select("span", "into", "run", "needed", "captures")
        pieces = staged(ordered.mapInArrow(trimmed(_merge_task(block)), cut_schema))
    sizes = pieces.groupBy("span").agg(F.sum(F.size("captures")).alias("n"))
    starts = sizes.select("span", F.expr("coalesce(sum(n) over (order by span rows between unbounded preceding and 1 preceding), 0)").alias("start"))
    inside = pieces.join(starts, "span").select((F.col("start") + F.col("part") * block).alias("start"), F.posexplode("captures").alias("i", "c"))
    return inside.select((F.col("start") + F.col("i")).alias("place"), "c.*")


def index_lines(history: DataFrame) -> DataFrame:
    """The index as text, in its order: URL key, time, URL, digest, type, length, place, file."""
    plain = F.concat_ws(
        " ", F.element_at(F.split("key", " "), 1), "timestamp", "url", "payload_digest", "record_type", "length", "offset", "file"
    )
    return history.orderBy("place").select(plain.alias("value"))
