"""Sharding by fixed virtual slots: a versioned slot-to-shard map that is edited, not recomputed, when loads move.

Every record hashes into one of a fixed number of slots; the slots' bytes are summed, and a map gives each slot a shard. Version 1 deals
the slots round robin. A rebalance goes through the slots from heavy to light and moves one to the lightest shard where that lowers the
heavier of the two; it writes the next version, so that readers of an older one keep their placement until they switch.

A map can be kept under a path: its versions are written one after the other, none is ever replaced, and any of them can be loaded. Sharding with
a kept map edits its newest version.

Native throughout: one projection of the records, partial sums per slot, a fold over the (fixed number of) slots, and a numbering that
works per slot. Only the map, whose size is the number of slots, is broadcast.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id hashes as the empty key; equal rows share a slot and are numbered
in any order among themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import materialise
from ledgerloom.sources.masters import path_exists


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8
    slots: int = 4096


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a record: the first 32 bits of the key's MD5, modulo the number of slots."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(slots))


def record_digests(docs: DataFrame, p: ShardParams) -> DataFrame:
    """One narrow row per record: id, size, checksum, slot."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    return rows.withColumn("vslot", slot_of(key, p.slots))


def slot_loads(records: DataFrame, p: ShardParams) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(p.slots).select(F.col("id").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def first_map(loads: DataFrame, p: ShardParams) -> DataFrame:
    return loads.select("vslot", F.lit(1).alias("version"), (F.col("vslot") % p.shards).cast("int").alias("shard"))


def rebalanced(loads: DataFrame, current: DataFrame, p: ShardParams) -> DataFrame:
    """The next version of ``current``: the same map but for the slots that moved."""
    slots = loads.join(current, "vslot").groupBy().agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "shard"))).alias("e"), F.max("version").alias("version")
    )
    fold = f"""aggregate(
        e,
        named_struct(
            'load', transform(sequence(0, {p.shards - 1}), k -> aggregate(filter(e, x -> x.shard = k), 0L, (s, x) -> s - x.neg)),
            'home', cast(array() as array<struct<vslot:bigint,shard:int>>)),
        (acc, x) -> transform(array(cast(array_position(acc.load, array_min(acc.load)) - 1 as int)), t ->
            if(acc.load[t] - x.neg < acc.load[x.shard],
               named_struct('load', transform(acc.load, (l, i) -> l - if(i = t, x.neg, 0L) + if(i = x.shard, x.neg, 0L)),
                            'home', concat(acc.home, array(named_struct('vslot', x.vslot, 'shard', t)))),
               named_struct('load', acc.load, 'home', concat(acc.home, array(named_struct('vslot', x.vslot, 'shard', x.shard))))))[0]
    ).home"""
    return slots.select(F.explode(F.expr(fold)).alias("h"), (F.col("version") + 1).alias("version")).select("h.vslot", "version", "h.shard")


def save_version(version: DataFrame, path: str) -> None:
    """Adds one version of a map to those under ``path``; a version that is there already is an error."""
    number = version.agg(F.max("version")).first()[0]
    version.coalesce(1).write.mode("error").parquet(f"{path}/version={number}")


def load_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(vslot, version, shard) of a version of the map under ``path``, the newest unless a number is given."""
    rows = spark.read.schema("vslot long, shard int, version int").parquet(path).select("vslot", "version", "shard")
    if number is None:
        number = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == number)


def shard_documents(docs: DataFrame, p: ShardParams = ShardParams(), path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with shard and gapless position in it, the map's current and next version).

    With a ``path`` the map that is kept there is edited, or begun, and its next version added.
    """
    records = materialise(record_digests(docs, p), "records")
    loads = materialise(slot_loads(records, p), "slot-loads")
    if path is None:
        current = first_map(loads, p)
    else:
        if not path_exists(docs.sparkSession, path):
            save_version(first_map(loads, p), path)
        current = load_version(docs.sparkSession, path)
    versions = materialise(current.unionByName(rebalanced(loads, current, p)), "slot-map")
    newest = versions.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))
    if path is not None:
        top = versions.agg(F.max("version")).first()[0]
        save_version(versions.filter(F.col("version") == top), path)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = newest.join(loads, "vslot").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("vslot", "shard", "base")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("at", F.row_number().over(within) - 1)
    out = numbered.join(F.broadcast(placed), "vslot")
    return out.withColumn("slot", F.col("base") + F.col("at")).drop("base", "at"), versions
