"""Archives: round trip, response or revisit against brute force, and that the files are plain Zstandard frames."""

import base64
import glob
import hashlib
import random

import zstandard

from ledgerloom.llm.warc import DICTIONARY_MAGIC, WarcParams, archive_folder, dictionary_of, parse, read_archive, write_archive


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw, lead = (html or "").encode(), first.get(html or "")
        revisit = lead is not None and lead != page_id
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 5}.example/é ü?q={i}", f"<html><body class='main'>{' '.join(str(rng.random()) for _ in range(rng.randrange(60)))}</body></html>") for i in range(300)]
    rows += [(1000 + i, None, rows[i % 7][2]) for i in range(50)] + [(-3, "http://a/", rows[9][2]), (2000, "x\r\ny", None), (2001, "y", ""), (None, "z", rows[9][2]), (None, "z", "only")]
    return rows + [(300, "http://same/", "again"), (300, "http://same/", "again"), (2002, "long", "<p>wide text</p>" * 100_000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, first string").repartition(3)
    path = archive_folder(spark)
    write_archive(df, path)
    got = read_archive(spark, path).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    payloads = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r.page_id, bytes(r.payload)) in payloads for r in got if r.record_type == "response")
    records = 0
    for name in glob.glob(path.removeprefix("file://") + "/part-*"):
        raw = open(name, "rb").read()
        assert raw[:4] == DICTIONARY_MAGIC
        stream = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary_of(raw))).stream_reader(raw, read_across_frames=True)
        text = stream.read()
        records += text.count(b"WARC/1.1\r\nWARC-Type: re")
        assert parse(text[: text.index(b"WARC/1.1", 5)])[0]["WARC-Type"] == "warcinfo" if b"WARC-Type: re" in text else True
    assert records == len(rows)


def test_few_and_none(spark):
    one = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    for df, n in ((one, 1), (one.limit(0), 0)):
        path = archive_folder(spark)
        write_archive(df, path)
        assert read_archive(spark, path).count() == n


def test_small_payloads_may_all_be_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = archive_folder(spark)
    write_archive(df, path, WarcParams(revisit_from=3))
    assert {r.page_id: r.record_type for r in read_archive(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
