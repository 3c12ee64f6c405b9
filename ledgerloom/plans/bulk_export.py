"""Export every ready invoice in one job; record the export only after the files are committed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import export as X
from ledgerloom.operators.ordinals import numbered
from ledgerloom.operators.state import as_events
from ledgerloom.operators.store import EventStore
from ledgerloom.params import EXPORTED, READY, Params


def plan_bulk(state: DataFrame, invoices: DataFrame, params: Params, gate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to export, refused with reason). The mandatory gate applies to single exports and is optional here."""
    ready = state.filter(F.col("status") == READY).select("stem", "notes")
    known = X.mandatory_gate(ready.join(invoices, "stem", "left"), params).withColumn("present", F.col("po_found").isNotNull())
    passes = F.col("present") & (F.col("exportable") | F.lit(not gate))
    reason = F.when(~F.col("present"), F.lit("no stored result")).otherwise(
        F.concat(F.lit("Missing mandatory fields: "), F.array_join("missing", ", "))
    )
    return known.filter(passes).drop("missing", "exportable", "present"), known.filter(~passes).select("stem", reason.alias("error"))


def exported_events(stems: DataFrame, at, fmt: str, first_seq: int, run_id: str) -> DataFrame:
    """One event per invoice; its number is decided by the stem's place in the run, so a repeated run gives the same events."""
    detail = F.to_json(F.struct(F.lit(fmt).alias("format"), F.lit(True).alias("bulk"), F.lit(run_id).alias("run")))
    placed = stems.select("stem", F.lit(0).alias("__all"), F.shiftrightunsigned(F.xxhash64("stem"), 1).alias("__at"))
    return as_events(numbered(placed, ["__all"], "__at", "n", range_bits=53).select(
        "stem", (F.lit(first_seq) + F.col("n") - 1).alias("seq"), at.alias("ts"), F.lit("status_changed").alias("op"),
        F.lit(EXPORTED).alias("status"), F.lit("system").alias("actor"), detail.alias("detail"),
    ))


def bulk_export(
    spark: SparkSession, payloads: Callable[[dt.datetime], DataFrame], at: dt.datetime, path: str, store: EventStore, fmt: str, first_seq: int, run_id: str
) -> None:
    """Write the run's files, then its events, each of them once however often the run is repeated.

    The first attempt fixes the run's time, with which ``payloads`` is called. An attempt that was cut off before its events begins anew and
    replaces its files; one that was cut off after them, when its invoices already count as exported, is only marked as finished.
    """
    if store.finished(spark, run_id):
        return
    at = store.begin(spark, run_id, at)
    if not store.appended(spark, run_id):
        rows = payloads(at)
        X.write_exports(rows, path, run_id, fmt)
        moment = F.lit(at.isoformat()).cast("timestamp")
        store.append(exported_events(rows.select("stem"), moment, fmt, first_seq, run_id), run_id, at)
    store.finish(spark, run_id)
