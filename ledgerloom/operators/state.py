"""Review state as a fold over an append-only event log.

One row per invoice is rebuilt from events with partial-aggregable "last writer" maxima: every
column keeps the latest event that sets it, and clearing a column is an event that sets null. No
window, so a stem with very many events is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.params import EXPORTED, NEEDS_REVIEW, STATUSES

# Event kinds. ``snapshot`` carries a whole state row (see ``snapshot_events``).
INSERTS = ("processed", "failed", "snapshot")
EVENT_COLUMNS = {
    "stem": "string", "seq": "bigint", "ts": "timestamp", "op": "string", "actor": "string", "status": "string",
    "source_file": "string", "source_mtime": "double", "invoice_number": "string", "invoice_date": "string",
    "due_date": "string", "supplier_name": "string", "matched_supplier": "string", "total": "decimal(18,4)",
    "currency": "string", "po_number": "string", "matched_po": "string", "error_count": "bigint",
    "warning_count": "bigint", "discrepancy_count": "bigint", "corrections": "string", "notes": "string",
    "exported_at": "timestamp", "processed_at": "timestamp", "processing_time_seconds": "double",
    "model_used": "string", "detail": "string",
}
RESULT_COLUMNS = (
    "source_file", "invoice_number", "invoice_date", "due_date", "supplier_name", "total", "currency", "po_number",
    "processing_time_seconds", "model_used",
)


def as_events(df: DataFrame) -> DataFrame:
    """Pad to the event schema."""
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()]
    )


def valid_status(events: DataFrame) -> Column:
    return (F.col("op") != "status_changed") | F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))


def rejected(events: DataFrame) -> DataFrame:
    """Status changes to an unknown status."""
    return events.filter(~valid_status(events))


def _op(*names: str) -> Column:
    return F.col("op").isin(*names)


def fold(events: DataFrame) -> DataFrame:
    """Current state per stem; a deleted invoice is absent until it is processed again."""
    at = F.struct("ts", "seq")
    ok = events.filter(valid_status(events)).withColumn("at", at)
    deleted = ok.filter("op = 'deleted'").groupBy("stem").agg(F.max("at").alias("gone"))
    live = ok.join(deleted, "stem", "left").filter(F.col("gone").isNull() | (F.col("at") > F.col("gone")))

    def last(name: str, writes: Column, *values: Column) -> Column:
        """Latest event with ``writes``; its values follow the event position in the struct."""
        return F.max(F.when(writes, F.struct(F.col("at").alias("at"), *values))).alias(name)

    c, null_text = F.col, F.lit(None).cast("string")
    kept = lambda op, column, kind="string": F.when(_op(op, "snapshot"), c(column)).cast(kind).alias("v")
    status = F.when(_op("failed", "reset"), F.lit(NEEDS_REVIEW)).otherwise(c("status"))
    errors = F.when(_op("failed"), F.lit(1)).otherwise(c("error_count")).cast("bigint")
    exported = F.when(_op("status_changed"), c("ts")).when(_op("snapshot"), c("exported_at"))
    row = live.groupBy("stem").agg(
        F.min(F.when(_op(*INSERTS), c("at"))).alias("start"),
        last("status_w", _op("processed", "failed", "status_changed", "reset", "snapshot")
             | (_op("reevaluated") & (c("status") == NEEDS_REVIEW)), status.alias("v")),
        last("exported_w", _op("processed", "reset", "snapshot") | (_op("status_changed") & (c("status") == EXPORTED)), exported.alias("v")),
        last("corrections_w", _op("corrections_saved", "processed", "failed", "reset", "snapshot"), kept("corrections_saved", "corrections")),
        last("notes_w", _op("notes_updated", "processed", "snapshot"), kept("notes_updated", "notes")),
        last("mtime_w", _op("processed", "failed", "reset", "snapshot"),
             F.when(_op("reset"), F.lit(0.0)).otherwise(c("source_mtime")).alias("v")),
        last("errors_w", _op("processed", "failed", "reevaluated", "snapshot"), errors.alias("v")),
        last("counts_w", _op("processed", "reevaluated", "snapshot"), c("warning_count"), c("discrepancy_count"),
             c("matched_supplier"), c("matched_po")),
        last("result_w", _op("processed", "snapshot"), *[c(k) for k in RESULT_COLUMNS]),
        last("at_w", _op("processed", "failed", "snapshot"), F.coalesce("processed_at", "ts").alias("v"), c("source_file")),
        F.max("at").alias("last_event"),
    ).filter("start is not null")

    def take(name: str, field: str = "v") -> Column:
        """The written value, unless it was written before the row existed."""
        return F.when(F.col(f"{name}.at") >= F.col("start"), F.col(f"{name}.{field}"))

    zero = F.lit(0).cast("bigint")
    return row.select(
        "stem",
        F.coalesce(take("result_w", "source_file"), take("at_w", "source_file")).alias("source_file"),
        take("status_w").alias("status"),
        *[take("result_w", k).alias(k) for k in RESULT_COLUMNS if k != "source_file"],
        take("counts_w", "matched_supplier").alias("matched_supplier"), take("counts_w", "matched_po").alias("matched_po"),
        F.coalesce(take("errors_w"), zero).alias("error_count"),
        F.coalesce(take("counts_w", "warning_count"), zero).alias("warning_count"),
        F.coalesce(take("counts_w", "discrepancy_count"), zero).alias("discrepancy_count"),
        take("corrections_w").alias("corrections"), take("notes_w").alias("notes"), take("exported_w").alias("exported_at"),
        take("at_w").alias("processed_at"), F.coalesce(take("mtime_w"), F.lit(0.0)).alias("source_mtime"),
        F.col("last_event.ts").alias("last_ts"), F.col("last_event.seq").alias("last_seq"),
    )


def snapshot_events(state: DataFrame) -> DataFrame:
    """A compacted log: one event per live invoice; fold it together with the newer tail."""
    return as_events(
        state.withColumn("op", F.lit("snapshot")).withColumnRenamed("last_ts", "ts").withColumnRenamed("last_seq", "seq")
    )


def processed_events(results: DataFrame) -> DataFrame:
    """Events that upsert a batch of results (columns as in ``RESULT_COLUMNS`` plus counts and status)."""
    return as_events(results.withColumn("op", F.lit("processed")).withColumn("actor", F.lit("system")))


def failed_events(failures: DataFrame) -> DataFrame:
    """Events for documents that could not be processed, with the whole message."""
    detail = F.to_json(F.struct(F.col("error").alias("error")))
    return as_events(failures.withColumn("op", F.lit("failed")).withColumn("actor", F.lit("system")).withColumn("detail", detail))


def accept_updates(requests: DataFrame, state: DataFrame, allowed: tuple[str, ...] = STATUSES) -> tuple[DataFrame, DataFrame]:
    """Split status requests into (accepted, rejected): the invoice must exist and the status be allowed."""
    marked = requests.join(state.select("stem", F.lit(True).alias("__known")), "stem", "left")
    good = F.coalesce("__known", F.lit(False)) & F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    return marked.filter(good).drop("__known"), marked.filter(~good).drop("__known")


def accept_changes(requests: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split re-evaluate, reprocess and delete requests: exported or unknown invoices are refused."""
    marked = requests.join(state.select("stem", F.col("status").alias("__now")), "stem", "left")
    good = F.col("__now").isNotNull() & (F.col("__now") != EXPORTED)
    return marked.filter(good).drop("__now"), marked.filter(~F.coalesce(good, F.lit(False))).drop("__now")


def audit_log(events: DataFrame) -> DataFrame:
    """The audit view of the log."""
    action = F.when(_op("failed"), F.lit("processing_failed")).when(
        _op("status_changed") & (F.col("status") == EXPORTED), F.lit("exported")
    ).otherwise(F.col("op"))
    return events.filter("op <> 'snapshot'").select(
        F.col("seq").alias("id"), "stem", F.col("ts").alias("timestamp"), action.alias("action"),
        F.coalesce("actor", F.lit("system")).alias("actor"),
        # the view shows the first 300 characters of a failure; the event keeps them all
        F.when(_op("failed") & F.get_json_object("detail", "$.error").isNotNull(),
               F.to_json(F.struct(F.substring(F.get_json_object("detail", "$.error"), 1, 300).alias("error"))))
        .otherwise(F.col("detail")).alias("detail"),
    )
