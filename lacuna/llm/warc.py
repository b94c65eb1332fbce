"""WARC records in ZIP-packaged archives, written and read back by ranges.

An archive is a ZIP file with the stored members `archive/data.warc.gz` (a gzip member for each record) and
`indexes/index.cdxj` (a JSON line for each record, with its offset and length in the data). The reader doesn't unpack
it: it parses the end record, the ZIP64 end record where there is one, and the central directory, finds where the
stored members' bytes begin, reads the index, and fetches each record by its range.

Of records with equal payloads one of those with the smallest page_id is the response; the others are revisits of it.
That is decided before anything is written: a light table (page_id, url, digest, size, a row number) is stored, so that
the row numbers stay what they are, and each digest's response is the least (page_id, row number) of it. A revisit
needs no payload, and a response takes it from the payloads grouped by digest: so each payload is shuffled once, copies
of a task meet before the shuffle, and no page or payload is a hot group. A task writes under a name of its own attempt
and renames at the end, so that a lost or repeated task leaves no half archive. Archives lie in the shared folder, by
pyarrow's file systems (local, HDFS, S3).

Defined results: a null html is an empty payload; payloads below `least` bytes are all responses; rows with the same
page_id and payload are one response and revisits of that page; a null page_id is the largest; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, stored

LEAST = 0
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records of one archive that one task reads, and gap between ranges that are fetched together.
RUN = 512
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: bytes, size: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit where the payload is None. sha1 and size are the payload's."""
    name = lambda p: "null" if p is None else str(p)
    revisit = payload is None
    block = HTTP % size + (payload or b"")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name(page_id)} {url}')}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c for c in (url or "") if c >= " "),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha1).decode()}",
        "X-Page-ID": name(page_id),
        "X-Payload-Length": str(size),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": name(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields: page_id, type, refers_to, payload (None for a revisit), digest and length as the record has them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: None if x in (None, "null") else int(x)
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["X-Page-ID"]),
        "type": fields["WARC-Type"],
        "refers_to": number(fields.get("X-Refers-To-Page-ID")) if revisit else None,
        "payload": None if revisit else payload,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "length": int(fields["X-Payload-Length"]),
    }


# ---------------------------------------------------------------- ZIP directories


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member begin, and how many they are. f: a file with seek and read."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            far = at(struct.unpack("<Q", locator[8:16])[0], 56)
            if far[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack("<QQQ", far[32:56])
    directory, out, p = at(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        local = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = at(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("broken ZIP member")
            out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        p += 46 + n_name + n_extra + n_comment
    return out


def opened(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


# ---------------------------------------------------------------- Spark


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        files, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        hidden = f"{base}/.{name}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        lines, at, data, archive, sink = [], 0, None, None, None
        for batch in batches:
            for page_id, url, sha, size, refers_to, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "size", "refers_to", "html"))):
                if data is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(hidden)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    data = archive.open(DATA, "w", force_zip64=True)
                payload = None if html is None else html.encode("utf-8")
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, payload, bytes.fromhex(sha), size, refers_to)) + packer.flush()
                data.write(raw)
                lines.append(json.dumps({"page_id": page_id, "offset": at, "length": len(raw)}))
                at += len(raw)
        if data is not None:
            data.close()
            with archive.open(INDEX, "w", force_zip64=True) as index:
                index.write("".join(x + "\n" for x in lines).encode())
            archive.close()
            sink.close()
            # The name tells the attempt apart: a task that runs again replaces nothing that another has read.
            final = f"{base}/{name}-{task.taskAttemptId()}.wacz"
            files.move(hidden, final)
            yield pa.RecordBatch.from_arrays([pa.array([folder.rstrip("/") + "/" + os.path.basename(final)]), pa.array([len(lines)], pa.int64())], names=["path", "records"])

    return run


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives; path and number of records of each."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    light = stored(own.withColumn("nth", F.monotonically_increasing_id()), "warc-rows")
    shared = light.filter(F.col("size") >= least)
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "nth", "url", "size")
    chosen = shared.groupBy("sha").agg(F.min(place).alias("x"))
    responses = chosen.select("sha", "x.page_id", "x.url", "x.size")
    if least > 0:
        responses = responses.unionByName(light.filter(F.col("size") < least).select("sha", "page_id", "url", "size"))
    payloads = pages.select(F.sha1(html).alias("sha"), html.alias("html")).groupBy("sha").agg(F.first("html").alias("html"))
    responses = responses.join(payloads, "sha").withColumn("refers_to", F.lit(None).cast("long"))
    others = shared.join(chosen, "sha").filter(F.col("nth") != F.col("x.nth"))
    others = others.select("sha", "page_id", "url", "size", F.lit(None).cast("string").alias("html"), F.col("x.page_id").alias("refers_to"))
    path = folder + "/manifest"
    rows = responses.unionByName(others).select("page_id", "url", "sha", "size", "refers_to", "html")
    bounded_batches(rows).mapInArrow(_write(folder), "path string, records long").write.parquet(path)
    return pages.sparkSession.read.schema("path string, records long").parquet(path)


def _list(run_length: int):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    found = members(f, f.size())
                    begin, n = found[INDEX]
                    f.seek(begin)
                    lines = [json.loads(x) for x in f.read(n).splitlines()]
                for i in range(0, len(lines), run_length):
                    part = lines[i : i + run_length]
                    offsets = pa.array([[found[DATA][0] + x["offset"] for x in part]], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), offsets, pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])

    return run


def _read(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "lengths"))):
                got = []
                with opened(path) as f:
                    for offset, n in zip(offsets, lengths):
                        f.seek(offset)
                        got.append(parse(zlib.decompress(f.read(n), 31)))
                for x in got:
                    if x["payload"] is not None and (digest(x["payload"]) != x["digest"] or len(x["payload"]) != x["length"]):
                        raise ValueError(f"{path}: a payload differs from its record's digest or length")
                column = lambda k, kind: pa.array([x[k] for x in got], kind)
                yield pa.RecordBatch.from_arrays(
                    [column("page_id", pa.int64()), column("length", pa.int64()), column("digest", pa.string()), column("type", pa.string()), column("refers_to", pa.int64()), pa.array([x["payload"] if with_payload else None for x in got], pa.binary())],
                    names=names,
                )

    return run


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of every record of the archives at `path`."""
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = archives.select("path").repartition(tasks).mapInArrow(_list(RUN), "path string, offsets array<long>, lengths array<long>")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return runs.repartition(tasks).mapInArrow(_read(with_payload), schema)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read(write(pages, scratch(spark, "warc"))).drop("payload")


def _sql() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hex digits are four characters of base32.
    character = f"substr('{alphabet}', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)"
    return f"""WITH p AS (SELECT row_number() OVER () AS nth, page_id, coalesce(html, '') AS t FROM pages),
    d AS (SELECT nth, page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
    k AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, nth))
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {character}), '') AS payload_digest,
      CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_id END AS refers_to FROM k"""


SQL = _sql()
