"""Recompute matches and findings of stored invoices after corrections or new master data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.export import apply_corrections, corrected_lines
from ledgerloom.params import NEEDS_REVIEW, Params
from ledgerloom.plans.reconcile import Masters, Reconciled, reconcile


def reevaluate(invoices: DataFrame, lines: DataFrame, corrections: DataFrame, masters: Masters, params: Params) -> Reconciled:
    """The batch plan over corrected invoices; the caller passes only those that may change."""
    effective = apply_corrections(invoices, corrections).drop("corr")
    stems = invoices.select("stem")
    changed = corrected_lines(lines.join(stems, "stem", "left_semi"), corrections.join(stems, "stem", "left_semi"))
    return reconcile(effective, changed, masters, params)


def reevaluated_status(results: DataFrame, state: DataFrame) -> DataFrame:
    """Findings force ``needs_review``; a clean result keeps the current status."""
    current = state.select("stem", F.col("status").alias("__now"))
    return results.join(current, "stem").withColumn(
        "status", F.when(F.col("requires_review"), F.lit(NEEDS_REVIEW)).otherwise(F.col("__now"))
    ).drop("__now")
