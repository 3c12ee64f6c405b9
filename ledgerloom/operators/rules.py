"""Discrepancy rules.

Header rules are one projection that builds an array of findings; line rules are one projection
over the line matches; order lines nobody billed come from one anti join. The three parts are
exploded and unioned into the long table, so no document's lines are gathered in one task.

Fixed values: the findings' names, severities and texts below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import fmt2, parse_date, plain_number, strip, truthy
from ledgerloom.params import MONEY, Params

SEVERITIES = ("error", "warning", "info")
_FINDINGS = (
    "array<struct<block:int,item:bigint,rule_ord:int,rule:string,type:string,severity:string,description:string,field:string,"
    "invoice_value:string,expected_value:string,po_line_number:bigint>>"
)


def _text(*parts: str | Column) -> Column:
    """Concatenate literals and columns; a null part reads ``None``."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(*cols)


def _finding(
    rule: str, kind: str, severity: str, description: Column, field: Column | str, invoice_value: Column | None = None,
    expected_value: Column | None = None, po_line_number: Column | None = None, block: int | None = None,
    item: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    field_col = F.lit(field) if isinstance(field, str) else field
    number = int(rule[1:])
    return F.struct(
        F.lit(block or number).alias("block"),
        (F.lit(0) if item is None else item).cast("bigint").alias("item"),
        F.lit(number).alias("rule_ord"),
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        field_col.alias("field"),
        (none if invoice_value is None else invoice_value.cast("string")).alias("invoice_value"),
        (none if expected_value is None else expected_value.cast("string")).alias("expected_value"),
        (F.lit(None) if po_line_number is None else po_line_number).cast("bigint").alias("po_line_number"),
    )


def field_value(name: str, columns: list[str]) -> Column:
    """A field by (dotted) name as text; names outside the invoice are looked up in the custom map."""
    root = name.split(".")[0]
    if root in columns:
        return F.col(name).cast("string")
    return F.get(F.array(F.element_at("custom_fields", name)), 0) if "custom_fields" in columns else F.lit(None).cast("string")


def is_missing(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def line_totals(lines: DataFrame) -> DataFrame:
    """Per invoice: line count, number and sum of known totals (map-side combined)."""
    return lines.groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("total").alias("n_totals"),
        F.sum("total").alias("lines_total"),
    )


def header_findings(inv: DataFrame, params: Params) -> DataFrame:
    """``inv`` carries the invoice, its matches and ``line_totals``; adds array ``findings``."""
    cols = inv.columns
    c = F.col
    today = F.lit(params.as_of)
    tol = F.lit(params.arithmetic_tolerance).cast("decimal(10,6)")
    number, date_text, due_text = c("invoice_number"), c("invoice_date"), c("due_date")
    total, subtotal, tax = c("total"), c("subtotal"), c("tax_amount")
    name = truthy(c("supplier.name"))
    none = F.array().cast(_FINDINGS)
    found_all: list[Column] = []

    def rule(cond: Column, finding: Column) -> None:
        found_all.append(F.when(cond, F.array(finding)).otherwise(none))

    # A lambda is interpreted with all that stands under it, so only these few checks do; beside one the projection is compiled in small methods.
    missing = F.array(*[
        F.when(
            is_missing(field_value(field, cols)),
            _finding("F1", "mandatory_field_missing", "error", F.lit(f"Mandatory field '{field}' is missing or empty"),
                     field, item=F.lit(i)),
        )
        for i, field in enumerate(params.mandatory_fields)
    ])
    found_all.append(F.filter(missing.cast(_FINDINGS), lambda x: x.isNotNull()))
    rule(truthy(number).isNull(),
         _finding("F2", "missing_invoice_number", "warning", F.lit("No invoice number found on the invoice"), "invoice_number"))
    rule(truthy(date_text).isNull(),
         _finding("F3", "missing_invoice_date", "warning", F.lit("No invoice date found on the invoice"), "invoice_date"))
    rule(name.isNull(),
         _finding("F4", "missing_supplier_name", "warning", F.lit("No supplier name could be extracted"), "supplier.name"))
    rule(total.isNull(),
         _finding("F5", "missing_total", "error", F.lit("No total amount found on the invoice"), "total"))
    rule(total == 0,
         _finding("F6", "zero_total", "warning", F.lit("Invoice total is zero"), "total", F.lit("0.00")))
    rule(total < 0,
         _finding("F7", "negative_amount", "error", _text("Invoice total is negative: ", fmt2(total)), "total", plain_number(total)))
    rule(c("n_lines").isNull(),
         _finding("F8", "missing_line_items", "info",
                  F.lit("No line items extracted — arithmetic cross-checks skipped"), "line_items"))

    summed = c("lines_total")
    rule((c("n_totals") > 0) & (F.abs(summed - subtotal) > tol),
         _finding("F10", "line_items_subtotal_mismatch", "error",
                  _text("Sum of line items (", fmt2(summed), ") does not match stated subtotal (", fmt2(subtotal), ")"),
                  "subtotal", fmt2(subtotal), fmt2(summed)))
    expected_tax = subtotal * c("tax_rate").try_cast("decimal(9,6)")
    rule(F.abs(expected_tax - tax) > tol,
         _finding("F11", "tax_calculation_mismatch", "warning",
                  _text("Tax amount (", fmt2(tax), ") does not match subtotal × rate (", fmt2(expected_tax), ")"),
                  "tax_amount", fmt2(tax), fmt2(expected_tax)))
    zero = F.lit(0).cast(MONEY)
    parts = subtotal + F.coalesce(tax, zero) + F.coalesce(c("shipping"), zero) + F.coalesce(c("other_charges"), zero)
    rule(F.abs(parts - total) > tol,
         _finding("F12", "grand_total_mismatch", "error",
                  _text("Grand total (", fmt2(total), ") does not match sum of components (", fmt2(parts), ")"),
                  "total", fmt2(total), fmt2(parts)))

    date, due = c("__date"), c("__due")
    ahead = F.date_diff(date, today)
    rule(ahead > params.max_future_days,
         _finding("F13", "invoice_date_future", "error",
                  _text("Invoice date ", date_text, " is ", ahead, " days in the future"),
                  "invoice_date", date_text, _text("<= ", today)))
    rule(-ahead > params.max_invoice_age_days,
         _finding("F14", "invoice_date_too_old", "warning",
                  _text("Invoice date ", date_text, " is ", -ahead, f" days in the past (threshold: {params.max_invoice_age_days} days)"),
                  "invoice_date", date_text, _text(">= ", F.date_sub(today, params.max_invoice_age_days))))
    rule(due < today,
         _finding("F15", "invoice_overdue", "warning", _text("Invoice due date ", due_text, " has already passed"), "due_date", due_text))
    rule(due < date,
         _finding("F16", "due_date_before_invoice", "error",
                  _text("Due date (", due_text, ") is before invoice date (", date_text, ")"),
                  "due_date", due_text, _text(">= ", date_text)))

    rule(c("matched_supplier").isNull() & name.isNotNull(),
         _finding("F17", "supplier_not_found", "warning",
                  _text("Supplier '", name, "' could not be matched to the supplier list"), "supplier.name", name))

    po = c("matched_po")
    referenced, found = po.isNotNull(), c("po_found")
    rule(referenced & ~found,
         _finding("F18", "po_not_found", "error",
                  _text("Invoice references PO '", c("po_number"), "' which was not found"), "po_number", c("po_number")))
    sid, po_sid = truthy(c("matched_supplier.supplier_id")), truthy(c("matched_po.po_supplier_id"))
    po_name = truthy(c("matched_po.po_supplier_name"))
    rule(found & (sid != po_sid),
         _finding("F19", "po_supplier_mismatch", "warning",
                  _text("Matched supplier ID '", sid, "' does not match PO supplier ID '", po_sid, "'"), "supplier.name", sid, po_sid))
    rule(found & (sid.isNull() | po_sid.isNull()) & (F.lower(name) != F.lower(po_name)),
         _finding("F20", "po_supplier_mismatch", "warning",
                  _text("Invoice supplier '", name, "' differs from PO supplier '", po_name, "'"), "supplier.name", name, po_name))
    po_total = c("matched_po.po_total")
    floor = F.greatest(po_total, F.lit("0.01").cast(MONEY))
    gap = F.abs(total - po_total)
    pct_text = F.format_string("%.1f", gap.cast("double") / floor.cast("double") * 100)
    rule(found & (gap > F.lit(params.po_total_tolerance_pct).cast("decimal(10,6)") * floor),
         _finding("F21", "po_total_exceeded", "error",
                  _text("Invoice total (", fmt2(total), ") differs from PO total (", fmt2(po_total), ") by ", pct_text, "%"),
                  "total", fmt2(total), fmt2(po_total)))
    if params.use_anchoring:
        abn = F.coalesce(truthy(c("supplier.abn")), c("supplier.acn"))
        rule(c("is_internal"),
             _finding("F26", "supplier_is_internal_entity", "error",
                      _text("Supplier identified as internal company (ABN: ", abn, "). Possible Supplier/Buyer inversion."),
                      "supplier.name"))

    dated = inv.withColumn("__date", parse_date(date_text)).withColumn("__due", parse_date(due_text))
    return dated.withColumn("findings", F.concat(*found_all)).drop("__date", "__due")


def negative_line_findings(lines: DataFrame) -> DataFrame:
    """F9 over the invoice lines."""
    i, nth = F.col("line_index"), F.col("line_index") + 1
    return lines.filter("total < 0").select(
        "stem",
        _finding("F9", "negative_amount", "warning",
                 _text("Line item ", nth, " has a negative total: ", fmt2(F.col("total"))),
                 _text("line_items[", i, "].total"), plain_number(F.col("total")), None, nth, item=i).alias("f"),
    )


def match_findings(matches: DataFrame) -> DataFrame:
    """F22-F24 over the line matches."""
    i, nth = F.col("line_index"), F.col("line_index") + 1
    desc, po_no = F.col("invoice_description"), F.col("po_line_number")
    none = F.array().cast(_FINDINGS)
    short, dear = F.col("quantity_matches").eqNullSafe(False), F.col("price_matches").eqNullSafe(False)
    checks = F.concat(*[F.when(cond, F.array(f)).otherwise(none) for cond, f in (
        (~F.col("matched"),
         _finding("F22", "po_line_not_found", "warning",
                  _text("Invoice line ", nth, " ('", desc, "') has no matching PO line"),
                  _text("line_items[", i, "]"), desc, None, nth, block=22, item=i)),
        (short,
         _finding("F23", "po_line_quantity_mismatch", "warning",
                  _text("Line ", nth, " quantity mismatch vs PO line ", po_no),
                  _text("line_items[", i, "].quantity"), plain_number(F.col("quantity")),
                  plain_number(F.col("expected_quantity")), po_no, block=22, item=i)),
        (dear,
         _finding("F24", "po_line_price_mismatch", "error",
                  _text("Line ", nth, " unit price mismatch vs PO line ", po_no),
                  _text("line_items[", i, "].unit_price"), plain_number(F.col("unit_price")),
                  plain_number(F.col("expected_unit_price")), po_no, block=22, item=i)),
    )])
    # most lines match: texts are built for the others only
    return matches.filter(~F.col("matched") | short | dear).select("stem", F.explode(checks).alias("f"))


def line_findings(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """F9 over the invoice lines and F22-F24 over their matches."""
    return negative_line_findings(lines).unionByName(match_findings(matches))


def unbilled_findings(unmatched_po: DataFrame) -> DataFrame:
    n = F.col("po_line_number")
    return unmatched_po.select(
        "stem",
        _finding("F25", "po_line_not_found", "info",
                 _text("PO line ", n, " was not found on the invoice (may be a partial delivery)"),
                 "line_items", None, _text("PO line ", n), n, block=25, item=F.col("po_pos")).alias("f"),
    )


def discrepancies(header: DataFrame, lines: DataFrame, matches: DataFrame, unmatched_po: DataFrame) -> DataFrame:
    """The long table; ``header`` is the output of ``header_findings``."""
    parts = [
        header.select("stem", F.explode("findings").alias("f")),
        line_findings(lines, matches),
        unbilled_findings(unmatched_po),
    ]
    return reduce(DataFrame.unionByName, parts).select("stem", "f.*")


def summarise(invoices: DataFrame, long: DataFrame) -> DataFrame:
    """Per invoice: counts per severity, whether it needs review, and the resulting status."""
    per = long.groupBy("stem").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count(F.lit(1)).alias("discrepancy_count"),
    )
    zero = {"error_count": 0, "warning_count": 0, "discrepancy_count": 0}
    review = (F.col("error_count") > 0) | (F.col("warning_count") > 0)
    return (
        invoices.join(per, "stem", "left").fillna(zero)
        .withColumn("requires_review", review)
        .withColumn("status", F.when(review, F.lit("needs_review")).otherwise(F.lit("ready")))
    )


def review_reasons(long: DataFrame) -> DataFrame:
    """Distinct error and warning texts per invoice, as rows."""
    return long.filter(F.col("severity").isin("error", "warning")).select("stem", F.col("description").alias("reason")).distinct()
