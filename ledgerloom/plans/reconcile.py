"""The batch plan: match, validate and summarise whole tables of invoices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import orders, rules, suppliers
from ledgerloom.params import Params
from ledgerloom.session import materialise


@dataclass(frozen=True)
class Masters:
    suppliers: DataFrame
    purchase_orders: DataFrame
    po_lines: DataFrame
    internal_companies: DataFrame


@dataclass(frozen=True)
class Reconciled:
    """Tables of one run; ``invoices`` has one row per document, the rest are long."""

    invoices: DataFrame
    line_matches: DataFrame
    unmatched_po_lines: DataFrame
    discrepancies: DataFrame
    results: DataFrame


def match_headers(invoices: DataFrame, masters: Masters, params: Params) -> DataFrame:
    with_supplier = suppliers.match_suppliers(invoices, masters.suppliers, params)
    flagged = suppliers.flag_internal(with_supplier, masters.internal_companies)
    return orders.lookup_orders(flagged, masters.purchase_orders)


def header_review_without_suppliers(invoices: DataFrame, lines: DataFrame, masters: Masters, params: Params) -> DataFrame:
    """Header rules but for those that need the matched supplier, whose findings are not valid here; the cascade does not run."""
    none = F.lit(None).cast(
        "struct<supplier_id:string,supplier_name:string,match_method:string,confidence:double,abn:string,"
        "matched_on:struct<field:string,value:string,fuzzy_score:double>>"
    )
    flagged = suppliers.flag_internal(invoices.withColumn("matched_supplier", none), masters.internal_companies)
    matched = orders.lookup_orders(flagged, masters.purchase_orders)
    return rules.header_findings(matched.join(rules.line_totals(lines), "stem", "left"), params)


def header_review(invoices: DataFrame, lines: DataFrame, masters: Masters, params: Params) -> DataFrame:
    """Header rules only: one row per invoice with its array of findings."""
    matched = match_headers(invoices, masters, params)
    return rules.header_findings(matched.join(rules.line_totals(lines), "stem", "left"), params)


def reconcile(invoices: DataFrame, lines: DataFrame, masters: Masters, params: Params) -> Reconciled:
    # Findings and results both read the header table: the supplier cascade runs once.
    header = materialise(header_review(invoices, lines, masters, params), "header")
    # The assignment needs only the order link, not the supplier cascade.
    links = orders.lookup_orders(invoices.select("stem", "po_number"), masters.purchase_orders)
    # Matches and left-over order lines both read the assignment: written once, not computed twice.
    found = materialise(orders.match_lines(links, lines, masters.po_lines, params), "assignment")
    matches, left_over = orders.line_matches(found), orders.unmatched_po_lines(found)
    long = rules.discrepancies(header, lines, matches, left_over)
    return Reconciled(header, matches, left_over, long, rules.summarise(header.drop("findings"), long))
