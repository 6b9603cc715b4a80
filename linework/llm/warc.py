"""WARC archives with revisit records, and their index by an external merge.

Pages are written as WARC 1.1 records, each a gzip member, in blocks of whole records; the blocks of an
archive, one after the other, are a .warc.gz file. A task writes one archive, and with each block a run: its
captures sorted by URL key and timestamp. Archives lie as rows of a table in the shared folder, so writing and
reading need nothing but Spark's own file access.

Reading parses the records of each block in the order of its run and writes the runs, in pieces of PIECE captures, as a
table. Ranges of (URL key, timestamp, page) are cut at places drawn from a sample of the captures, and pieces that lie across a
cut are split there. In each range Spark sorts the pieces, by which it can spill, by their first captures; this is the
order in which a merge needs them (forecasting: Knuth, The Art of Computer Programming 3, 5.4.9). So the merge reads a stream:
a loser tree holds the heads of the runs whose pieces have begun, at most one piece for each run, and when its least capture
is not before the next piece's first, that piece joins. The ranges one after the other are the capture history of the whole.

Of records with equal payloads of at least LEAST bytes the one of the smallest page_id is the response and the others
refer to it; what is said of a revisit is what was read of the record that it refers to, which must be there. Defined cases: a
null html is empty, a null url an empty one; rows that repeat the page_id of
the response with the same payload are responses too; a null page_id is never referred to unless it
stands alone; an empty table writes nothing. A very long html is one record, held whole by one task. Other columns are left alone.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LEAST = 100
#: Captures in a piece of a run.
PIECE = 256
BLOCK_BYTES = 1_000_000
EPOCH = datetime.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly key of a URL: the host's parts from the last, then port, path and query, all in lower case."""
    try:
        at = urlsplit(url)
        host, port = at.hostname or "", at.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (at.path or "/") + (f"?{at.query}" if at.query else "")).lower()


def timestamp(page_id) -> str:
    """Pages have no time of their own: their number in seconds since EPOCH stands for it."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def write_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member; a revisit has the payload's length and digest but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {timestamp(page_id)}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class BadRecord(ValueError):
    pass


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of a record."""
    raw = zlib.decompress(data, 31)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not mark or not version.startswith("WARC/"):
        raise BadRecord(version[:40])
    size = int(fields["content-length"])
    body = rest[:size]
    if len(body) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord(f"{fields['warc-record-id']}: {len(rest)} bytes, not {size}")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, _fields(http)[1], payload


class LoserTree:
    """Merges sorted sequences: inner places of a tree hold the losers of the matches played there, so each next item costs one
    match on each level of its leaf's path. Sequences may join while it runs; the tree is played anew then, and the leaves
    of those that have ended are used again."""

    def __init__(self, runs=()):
        self.runs: list[Iterator] = []
        self.heads: list = []
        self.losers: list[int] = [-1]
        self.most = 0  # sequences held at once
        self.join(*runs)

    def join(self, *runs) -> None:
        live = [k for k, h in enumerate(self.heads) if h is not None]
        self.runs, self.heads = [self.runs[k] for k in live], [self.heads[k] for k in live]
        for run in map(iter, runs):
            if (head := next(run, None)) is not None:
                self.runs.append(run)
                self.heads.append(head)
        self.most = max(self.most, len(self.runs))
        self.losers = [-1] * max(1, len(self.runs))
        for leaf in range(len(self.runs) - 1, -1, -1):
            self._seat(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; -1 comes before all and is only there while seating."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None or (x is None and y is None and a < b)
        return (x, a) < (y, b)

    def _seat(self, winner: int) -> None:
        at = (winner + len(self.losers)) // 2
        while at > 0:
            if self._less(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def peek(self):
        """The least head, None if all sequences have ended."""
        return self.heads[self.losers[0]] if self.heads else None

    def pop(self):
        run = self.losers[0]
        item = self.heads[run]
        self.heads[run] = next(self.runs[run], None)
        self._seat(run)
        return item

    def __iter__(self) -> Iterator:
        while self.peek() is not None:
            yield self.pop()


def merged(pieces: Iterator[tuple[tuple, list[tuple]]], tree: LoserTree | None = None) -> Iterator[tuple]:
    """The items of pieces (first item's key, items (key, ...)) in order of their keys; the pieces come sorted by first key, items within
    a piece are sorted. Only pieces that have begun and not ended are held."""
    tree = LoserTree() if tree is None else tree
    for first, items in pieces:
        while (head := tree.peek()) is not None and head[0] <= first:
            yield tree.pop()
        tree.join(items)
    yield from tree


ARCHIVE = "archive long, block int, data binary, run array<struct<url_key:string,ts:string,page_id:long,start:long,length:long>>"


def _sorted_key(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of (page_id, url, html) as a table of ARCHIVE. The first page of a payload is found by a minimum
    that is combined before the shuffle; the join to it can be split for a payload that very many pages have."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.coalesce("page_id", F.lit(-(2**63))), F.col("first")))

    def run(batches):
        from pyspark import TaskContext

        archive, block, data, size, captures = TaskContext.get().partitionId(), 0, [], 0, []

        def out():
            run = [{"url_key": c[0], "ts": c[1], "page_id": c[2], "start": c[3], "length": c[4]} for c in sorted(captures, key=_sorted_key)]
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.int64()), pa.array([block], pa.int32()), pa.array([b"".join(data)], pa.binary()), pa.array([run], RUN)], names=["archive", "block", "data", "run"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url = page_id.as_py(), url.as_py()
                record = write_record(page_id, url, html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())
                captures.append((url_key(url), timestamp(page_id), page_id, size, len(record)))
                data.append(record)
                size += len(record)
                if size >= BLOCK_BYTES:
                    yield out()
                    block, data, size, captures = block + 1, [], 0, []
        if data:
            yield out()

    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, ARCHIVE)


RUN = pa.list_(pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
CAPTURE = "struct<url_key:string,ts:string,page_id:long,payload_bytes:long,payload_digest:string,record_type:string,refers_to:long>"
PIECES = f"url_key string, ts string, page_id long, run long, place int, captures array<{CAPTURE}>"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts string"


def _number(record: str):
    found = record.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


def read_archives(archives: DataFrame, piece: int = PIECE) -> DataFrame:
    """The runs in pieces: the captures of each block in the order of its run; digests and lengths of responses are of the payloads
    read, a revisit has no length until it is resolved()."""
    shape = _arrow(PIECES)

    def run(batches):
        for batch in batches:
            for archive, block, data, captures in zip(*(batch.column(k) for k in ("archive", "block", "data", "run")), strict=True):
                whole = memoryview(data.as_buffer())
                found = []
                for c in captures.as_py():
                    fields, _, payload = read_record(whole[c["start"] : c["start"] + c["length"]])
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else said
                    if digest != said or _number(fields["warc-record-id"]) != c["page_id"]:
                        raise BadRecord(f"{fields['warc-record-id']} is not what the index says")
                    refers_to = _number(fields["warc-refers-to"]) if kind == "revisit" else None
                    found.append({"url_key": c["url_key"], "ts": c["ts"], "page_id": c["page_id"], "payload_bytes": len(payload) if kind == "response" else None, "payload_digest": digest, "record_type": kind, "refers_to": refers_to})
                own = archive.as_py() << 24 | block.as_py()
                rows = [(*(found[at][k] for k in ("url_key", "ts", "page_id")), own, at, found[at : at + piece]) for at in range(0, len(found), piece)]
                yield _batch(rows, shape)

    return archives.mapInArrow(run, PIECES)


def _arrow(schema: str) -> pa.Schema:
    """Made on the driver, as workers have no session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], names=fields.names)


def _key(c: dict) -> tuple:
    return c["url_key"], c["ts"], c["page_id"] is not None, c["page_id"] or 0


def _cuts(pieces: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 keys that cut the captures into about equal parts, from a sample of all captures that is bounded by the
    number of ranges."""
    n = pieces.agg(F.sum(F.size("captures"))).first()[0] or 1
    keys = pieces.select("run", "place", F.posexplode(F.transform("captures", lambda c: F.struct(c["url_key"].alias("url_key"), c["ts"].alias("ts"), c["page_id"].alias("page_id")))).alias("k", "c"))
    some = keys.where(F.pmod(F.xxhash64("run", "place", "k"), F.lit(n)) < 40 * ranges).select("c.*").limit(80 * ranges).collect()
    keys = sorted({_key(r.asDict()) for r in some})
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if len(keys) > ranges else keys[1:]


def merge_runs(pieces: DataFrame, ranges: int | None = None) -> DataFrame:
    """RESULT rows, and the range they lie in, in global order of URL key, timestamp and page, of runs in pieces, which are read
    more than once: pass a table. Each range is a partition and a stream; a task holds one piece of each run at most."""
    spark = pieces.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(_cuts(pieces, ranges))
    dealt, result = PIECES + ", range int", RESULT + ", range int"
    dealt_fields, result_fields = _arrow(dealt), _arrow(result)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def split(batches):
        for batch in batches:
            rows = []
            for run, place, captures in zip(*(batch.column(k).to_pylist() for k in ("run", "place", "captures")), strict=True):
                keys = [_key(c) for c in captures]
                at = 0
                while at < len(keys):
                    r = bisect.bisect_right(cuts.value, keys[at])
                    end = bisect.bisect_left(keys, cuts.value[r], at) if r < len(cuts.value) else len(keys)
                    rows.append((*(captures[at][k] for k in ("url_key", "ts", "page_id")), run, place + at, captures[at:end], r))
                    at = end
            yield _batch(rows, dealt_fields)

    def run(batches):
        def arriving():
            for batch in batches:
                for r, captures in zip(batch.column("range").to_pylist(), batch.column("captures"), strict=True):
                    items = [((r, *_key(c)), r, c) for c in captures.as_py()]
                    yield items[0][0], items

        out = []
        for _, r, c in merged(arriving()):
            out.append((*(c[k] for k in names), r))
            if len(out) == 5000:
                yield _batch(out, result_fields)
                out = []
        yield _batch(out, result_fields)

    order = ["range", "url_key", "ts", F.col("page_id").asc_nulls_first(), "run", "place"]
    streams = pieces.select("run", "place", "captures").mapInArrow(split, dealt).repartitionById(ranges, F.col("range")).sortWithinPartitions(*order)
    return streams.mapInArrow(run, result)


def resolved(captures: DataFrame) -> DataFrame:
    """The captures with each revisit's length from the response that it refers to; a revisit without such a record is an error."""
    whole = cut(captures.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("its_bytes")), "responses")
    met = captures.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("a revisit refers to a record that is not there: "), F.col("refers_to").cast("string"))).cast("long")
    return captures.where("record_type = 'response'").unionByName(met.withColumn("payload_bytes", F.coalesce("its_bytes", lost)).drop("its_bytes").select(captures.columns))


def capture_histories(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write (page_id, url, html) to archives, read them back, and give their captures in global order."""
    return merge_runs(cut(read_archives(cut(write_archives(pages, least), "archives")), "runs"))


def export(archives: DataFrame, folder: str) -> None:
    """Write the archives as .warc.gz files into a folder that the driver can reach, block by block."""
    import os

    os.makedirs(folder, exist_ok=True)
    for row in archives.orderBy("archive", "block").select("archive", "data").toLocalIterator():
        with open(os.path.join(folder, f"part-{row.archive:05d}.warc.gz"), "ab") as f:
            f.write(row.data)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the histories of all pages say of each."""
    histories = cut(capture_histories(table(spark, sf_dir, "pages", "page_id", "url", "html")), "histories")
    return resolved(histories).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
