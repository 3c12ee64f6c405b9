"""WARC archives with a Zstandard dictionary: one leading skippable frame holds it, and every record is a frame of its own.

The archive folder is written by Spark's own writer, one file a task, so that a lost executor's file is simply written again and the folder
may be in any store that Spark reaches. The writer puts a separator after every row; the separator used here is itself an empty skippable
frame, so each file is a plain sequence of frames that any Zstandard reader takes: dictionary, then records. The same separator
lets readers split large files between tasks.

The dictionary is trained on a bounded, documented sample of the records to be written (``sample_rows`` records chosen by a hash of the id,
at most ``sample_bytes`` of each). It only steers compression.

Of records with equal payloads (of ``revisit_from`` bytes or more) the one with the smallest page_id is a response, the others are revisits
that name it. Digests are compared through SHA-1 of the full payload; minima are aggregated before the shuffle.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; rows without a page_id come after all others of
their payload, and where only such rows have it, all are responses; repeated rows that hold the smallest page_id are all
responses; an empty table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import materialise
from ledgerloom.llm.textkit import slices
from ledgerloom.session import shared_dir

# Magic numbers of skippable frames (the dictionary's and an empty one) and the profile of revisits.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    revisit_from: int = 0
    sample_rows: int = 400
    sample_bytes: int = 16 << 10
    dictionary_bytes: int = 32 << 10
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes], p: WarcParams) -> bytes:
    """A dictionary, or as a last resort the samples' own bytes (a raw dictionary), or nothing."""
    try:
        return zstandard.train_dictionary(p.dictionary_bytes, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-p.dictionary_bytes :]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed


def dictionary_of(frame: bytes) -> bytes:
    size = struct.unpack("<I", frame[4:8])[0]
    return zstandard.ZstdDecompressor().decompress(frame[8 : 8 + size])


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, p: WarcParams) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP header, and with it the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = payload_digest(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", p.date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(first)), ("X-Refers-To-Page-ID", str(first))]
    block = http if revisit else http + payload
    return _head([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def info_record(p: WarcParams) -> bytes:
    block = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info')}>"), ("WARC-Date", p.date),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; its length and, for a response, its payload digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, rest[:size]


def _frame(compressor: zstandard.ZstdCompressor, raw: bytes, dictionary) -> bytes:
    """One frame without the separator's bytes in it; where they came up by chance, another level spells it anew."""
    out = compressor.compress(raw)
    level = 1
    while SEPARATOR in out + SEPARATOR[:-1]:
        if level > 19:
            raise ValueError("no level spells this record without the separator")
        out = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=level % 2 == 0).compress(raw)
        level += 1
    return out


def _dict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def _writer(p: WarcParams, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _dict(dictionary)
        if data is not None:
            data.precompute_compress(level=p.level)
        compressor = zstandard.ZstdCompressor(level=p.level, dict_data=data, write_checksum=True)
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_frame(dictionary), _frame(compressor, info_record(p), data)], pa.binary())], names=["frame"])
        for piece in (s for b in batches for s in slices(b, "html")):
            rows = zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html", "first")))
            frames = []
            for page_id, url, html, first in rows:
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisit = first is not None and first != page_id
                frames.append(_frame(compressor, record(page_id, url, payload, first, revisit, p), data))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    return run


def _samples(pages: DataFrame, p: WarcParams) -> list[bytes]:
    n = pages.count()
    share = int(1_000_000 * min(1.0, p.sample_rows / n)) + 1 if n else 0
    chosen = pages.filter(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(1_000_000)) < share)
    rows = chosen.select(F.substring("html", 1, p.sample_bytes).alias("t")).filter("t <> ''").limit(2 * p.sample_rows).collect()
    return [record(0, None, r["t"].encode(), None, False, p) for r in rows]


def write_archive(pages: DataFrame, path: str, p: WarcParams = WarcParams()) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) into the folder ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    large = rows.filter(F.octet_length("html") >= p.revisit_from) if p.revisit_from else rows
    seen = large.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    shared = materialise(seen.select("sha1", "first"), "repeated-payloads")
    dictionary = train(_samples(pages, p), p)
    named = rows.join(shared, "sha1", "left").select("page_id", "url", "html", "first")
    frames = named.mapInArrow(_writer(p, dictionary), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def _reader(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))
        for batch in batches:
            out = []
            for frame in batch.column("frame").to_pylist():
                if frame[:4] == DICTIONARY_MAGIC:
                    continue
                fields, block = parse(unpack.decompress(frame))
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was written")
                ids = [int(fields[f]) if f in fields else None for f in ("X-Page-ID", "X-Refers-To-Page-ID")]
                out.append((ids[0], size, digest, kind, ids[1], fields["WARC-Target-URI"], payload))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return run


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive folder: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, payload."""
    rows = spark.read.option("lineSep", SEPARATOR.decode("ascii")).text(path).select(F.col("value").cast("binary").alias("frame"))
    found = rows.filter(F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)).take(1)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
    return rows.mapInArrow(_reader(dictionary_of(bytes(found[0][0])) if found else b""), schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive in the cluster's shared folder."""
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
