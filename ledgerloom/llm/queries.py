"""Registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.winnowing import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm.bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.probminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.warc import archive_folder, read_archive, write_archive

    path = archive_folder(spark)
    write_archive(_table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.prefix_forest import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.packing import best_fit

    return best_fit(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.phrases import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.sharding import shard_documents

    rows, _ = shard_documents(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


OP10_SQL = """
with recursive bits as (
    select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t
    from range(256) r(i)
), raw as (
    select row_number() over () as rid, doc_id, strlen(coalesce(text, '')) + 1 as size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as b
    from documents
), rec0 as (
    select rid, doc_id, size,
           xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) as text_crc32
    from raw, bits
), rec as (
    select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text_crc32::varchar), 1, 8))::bigint % 4096 as vslot from rec0
), loads as (
    select s.vslot, coalesce(sum(size), 0)::bigint as bytes, count(size) as n
    from range(4096) s(vslot) left join rec using (vslot) group by s.vslot
), ordered as (
    select row_number() over (order by bytes desc, vslot) as k, vslot, bytes, (vslot % 8)::int as home from loads
), start as (
    select list(b order by home) as load from (select home, sum(bytes)::bigint as b from ordered group by home)
), fold(k, load, vslot, shard) as (
    select 0::bigint, load, -1::bigint, -1 from start
    union all
    select o.k,
           case when moved then list_transform(f.load, lambda l, i: (l + case when i = t then o.bytes else 0 end - case when i = o.home + 1 then o.bytes else 0 end)::bigint) else f.load end,
           o.vslot, case when moved then (t - 1)::int else o.home end
    from (select *, list_position(load, list_min(load)) as t from fold) f
    join ordered o on o.k = f.k + 1,
    lateral (select f.load[t] + o.bytes < f.load[o.home + 1] as moved) m
), placed as (
    select f.vslot, f.shard, coalesce(sum(l.n) over (partition by f.shard order by f.vslot rows between unbounded preceding and 1 preceding), 0) as base
    from fold f join loads l on l.vslot = f.vslot where f.k > 0
)
select r.doc_id, r.size, r.text_crc32, 'bytes' as law, p.shard,
       (p.base + row_number() over (partition by r.vslot order by r.doc_id, r.text_crc32, r.size) - 1)::bigint as slot,
       null::int as grown_shard, r.vslot
from rec r join placed p on p.vslot = r.vslot
"""

def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.quality import judge

    rows = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select(*base, "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.periodic import collapse_runs

    return collapse_runs(_table(spark, sf_dir, "documents"), plant=F.crc32(F.col("doc_id").cast("string").cast("binary")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from string import ascii_lowercase, ascii_uppercase

    from ledgerloom.llm.merkle import manifest_rows

    tampered = {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}
    rows = manifest_rows(_table(spark, sf_dir, "documents"), tampered, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _entry(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


_BEFORE_TEXT = " || ".join(_entry(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP13_SQL = f"""
with recursive bits as (
    select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t
    from range(256) r(i)
), docs as (
    select row_number() over () as rid, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
           list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda x: ('0x' || x)::bigint) as b
    from documents
), leaves as (
    select rid, doc_id, source, leaf, case when doc_id is not null and crc % 5 = 0 then other else leaf end as now,
           row_number() over (partition by source order by doc_id nulls first, leaf, rid) - 1 as pos, count(*) over (partition by source) as n
    from (select *, sha256({_BEFORE_TEXT} || {_entry('text')}) as leaf, sha256({_BEFORE_TEXT} || {_entry('low')}) as other,
                 xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) as crc
          from docs, bits)
), nodes(level, source, pos, n, h) as (
    select 0, source, pos, n, leaf from leaves
    union all
    select level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by level, source, pos // 16, n
), subroots as (
    select source, level, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), tops(level, pos, n, h) as (
    select 0, pos, n, h from subroots
    union all
    select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 16, n
), places as (
    select l.rid, d.level as step, d.pos, l.pos // (16 ** d.level)::bigint as own, d.h
    from leaves l join nodes d on d.source is not distinct from l.source and d.n > 1 and d.pos // 16 = l.pos // (16 ** (d.level + 1))::bigint
    union all
    select l.rid, s.level + d.level, d.pos, s.pos // (16 ** d.level)::bigint, d.h
    from leaves l join subroots s on s.source is not distinct from l.source join tops d on d.n > 1 and d.pos // 16 = s.pos // (16 ** (d.level + 1))::bigint
), steps as (
    select rid, step, coalesce(string_agg(h, '' order by pos) filter (pos < own), '') as lft, coalesce(string_agg(h, '' order by pos) filter (pos > own), '') as rgt
    from places group by rid, step
), fold(rid, step, now) as (
    select rid, 0, now from leaves
    union all
    select f.rid, f.step + 1, sha256(lft || now || rgt) from fold f join steps s on s.rid = f.rid and s.step = f.step
), folded as (select rid, arg_max(now, step) as folded_root from fold group by rid),
proofs as (select rid, sha256(string_agg(lft || rgt, '' order by step)) as proof_sha256 from steps group by rid)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.folded_root, f.folded_root = r.h as verified
from leaves l join subroots s on s.source is not distinct from l.source join (select h from tops where n = 1) r on true
join folded f on f.rid = l.rid left join proofs p on p.rid = l.rid
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_bpe": op2_bpe,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_nearest": op6_nearest,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_quality_rules": op11_quality_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}
ORACLES = {"op10_sharding": OP10_SQL, "op13_merkle_manifest": OP13_SQL}
