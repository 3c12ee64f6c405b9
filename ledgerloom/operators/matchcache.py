"""Similar-name matches that outlive a run.

A name's best match depends on the name and on the master's names alone. Under a path, each version of the master (a checksum of its names, their
order and the threshold) has a table of the names that were scored against it, with their match or without one; a run scores the names that
its version does not know yet and adds them. A changed master file is another version and begins anew.

Two runs at once may add a name twice; both rows say the same, and reading takes one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise
from ledgerloom.sources.masters import path_exists

_SCHEMA = "name_key string, supplier_ord bigint, score double"


def version_of(names: DataFrame, threshold: int) -> str:
    """A checksum of the master's names (supplier_ord, name_ord, name_key); the driver sees one row."""
    sums = [F.bit_xor(F.xxhash64("supplier_ord", "name_ord", "name_key", F.lit(salt))) for salt in (1, 2)]
    row = names.agg(F.count(F.lit(1)), *sums).first()
    return "-".join(str(v if v is not None else 0) for v in (threshold, *row)).replace("--", "-n")


def cached_best(
    keys: DataFrame, names: DataFrame, threshold: int, path: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``score(keys)`` (name_key, supplier_ord, score), of which only the names that are not in the cache are computed."""
    spark, folder = keys.sparkSession, f"{path}/{version_of(names, threshold)}"
    known = spark.read.schema(_SCHEMA).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], _SCHEMA)
    fresh = materialise(keys.join(known, "name_key", "left_anti"), "fresh-names")
    scored = fresh.join(score(fresh), "name_key", "left").select("name_key", F.col("supplier_ord").cast("bigint"), "score")
    scored = materialise(scored, "fresh-matches")
    if not scored.isEmpty():
        scored.write.mode("append").parquet(folder)
    both = known.join(keys, "name_key", "left_semi").distinct().unionByName(scored)
    return both.filter("supplier_ord is not null")
