"""Queries and oracles: discrepancy rules, summaries and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.matching import ASSIGN, CASCADE, FLAGS, date_sql
from ledgerloom.operators import rules as RU
from ledgerloom.plans import reconcile as R

QUERIES, ORACLES = {}, {}
OUT = ["stem", "rule", "item", "type", "severity", "description", "field", "invoice_value", "expected_value", "po_line_number"]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def m(c: str) -> str:
    return f"printf('%.2f', ({c})/100.0)"


def num(c: str) -> str:
    return f"regexp_replace(cast(cast(({c})/100.0 as decimal(18,4)) as varchar), '0{{1,3}}$', '')"


AS_OF = "date '1998-06-30'"


def _rule(rule: str, item: str, kind: str, sev: str, desc: str, field: str, iv: str, ev: str, po: str, src: str, cond: str) -> str:
    return (f"select stem, '{rule}' as rule, cast({item} as bigint) as item, '{kind}' as type, '{sev}' as severity, {desc} as description,"
            f" {field} as field, cast({iv} as varchar) as invoice_value, cast({ev} as varchar) as expected_value,"
            f" cast({po} as bigint) as po_line_number from {src} where {cond}")


H = "hd"
BLANK = "coalesce(trim({c})='', true)"


def _mandatory(i: int, field: str, cond: str) -> str:
    return _rule("F1", str(i), "mandatory_field_missing", "error", f"'Mandatory field ''{field}'' is missing or empty'", f"'{field}'",
                 "null", "null", "null", H, cond)


HEADER_RULES = [
    _mandatory(0, "invoice_date", BLANK.format(c="invoice_date")),
    _mandatory(1, "invoice_number", BLANK.format(c="invoice_number")),
    _mandatory(2, "supplier.name", BLANK.format(c="s_name")),
    _mandatory(3, "total", "total_cents is null"),
    _rule("F2", "0", "missing_invoice_number", "warning", "'No invoice number found on the invoice'", "'invoice_number'", "null", "null", "null", H, "coalesce(invoice_number,'')=''"),
    _rule("F3", "0", "missing_invoice_date", "warning", "'No invoice date found on the invoice'", "'invoice_date'", "null", "null", "null", H, "coalesce(invoice_date,'')=''"),
    _rule("F4", "0", "missing_supplier_name", "warning", "'No supplier name could be extracted'", "'supplier.name'", "null", "null", "null", H, "coalesce(s_name,'')=''"),
    _rule("F5", "0", "missing_total", "error", "'No total amount found on the invoice'", "'total'", "null", "null", "null", H, "total_cents is null"),
    _rule("F6", "0", "zero_total", "warning", "'Invoice total is zero'", "'total'", "'0.00'", "null", "null", H, "total_cents = 0"),
    _rule("F7", "0", "negative_amount", "error", f"'Invoice total is negative: ' || {m('total_cents')}", "'total'", num("total_cents"), "null", "null", H, "total_cents < 0"),
    _rule("F8", "0", "missing_line_items", "info", "'No line items extracted — arithmetic cross-checks skipped'", "'line_items'", "null", "null", "null", H, "n_lines is null"),
    _rule("F10", "0", "line_items_subtotal_mismatch", "error",
          f"'Sum of line items (' || {m('lines_cents')} || ') does not match stated subtotal (' || {m('subtotal_cents')} || ')'",
          "'subtotal'", m("subtotal_cents"), m("lines_cents"), "null", H, "abs(lines_cents-subtotal_cents) > 5"),
    _rule("F11", "0", "tax_calculation_mismatch", "warning",
          f"'Tax amount (' || {m('tax_cents')} || ') does not match subtotal × rate (' || {m('floor(subtotal_cents/10.0+0.5)')} || ')'",
          "'tax_amount'", m("tax_cents"), m("floor(subtotal_cents/10.0+0.5)"), "null", H, "abs(subtotal_cents-10*tax_cents) > 50"),
    _rule("F12", "0", "grand_total_mismatch", "error",
          f"'Grand total (' || {m('total_cents')} || ') does not match sum of components (' || {m('subtotal_cents+tax_cents')} || ')'",
          "'total'", m("total_cents"), m("subtotal_cents+tax_cents"), "null", H, "abs(subtotal_cents+tax_cents-total_cents) > 5"),
    _rule("F13", "0", "invoice_date_future", "error", f"'Invoice date ' || invoice_date || ' is ' || date_diff('day', {AS_OF}, d) || ' days in the future'",
          "'invoice_date'", "invoice_date", "'<= 1998-06-30'", "null", H, f"date_diff('day', {AS_OF}, d) > 7"),
    _rule("F14", "0", "invoice_date_too_old", "warning",
          f"'Invoice date ' || invoice_date || ' is ' || date_diff('day', d, {AS_OF}) || ' days in the past (threshold: 90 days)'",
          "'invoice_date'", "invoice_date", "'>= 1998-04-01'", "null", H, f"date_diff('day', d, {AS_OF}) > 90"),
    _rule("F15", "0", "invoice_overdue", "warning", "'Invoice due date ' || due_date || ' has already passed'", "'due_date'", "due_date", "null", "null", H, f"due < {AS_OF}"),
    _rule("F16", "0", "due_date_before_invoice", "error", "'Due date (' || due_date || ') is before invoice date (' || invoice_date || ')'",
          "'due_date'", "due_date", "'>= ' || invoice_date", "null", H, "due < d"),
    _rule("F17", "0", "supplier_not_found", "warning", "'Supplier ''' || s_name || ''' could not be matched to the supplier list'", "'supplier.name'", "s_name", "null", "null", H,
          "sid is null and coalesce(s_name,'')<>''"),
    _rule("F18", "0", "po_not_found", "error", "'Invoice references PO ''' || po_ref || ''' which was not found'", "'po_number'", "po_ref", "null", "null", H,
          "wanted is not null and po_key is null"),
    _rule("F19", "0", "po_supplier_mismatch", "warning", "'Matched supplier ID ''' || sid || ''' does not match PO supplier ID ''' || po_supplier_id || ''''",
          "'supplier.name'", "sid", "po_supplier_id", "null", H, "po_key is not null and sid <> po_supplier_id"),
    _rule("F20", "0", "po_supplier_mismatch", "warning", "'Invoice supplier ''' || s_name || ''' differs from PO supplier ''' || po_supplier_name || ''''",
          "'supplier.name'", "s_name", "po_supplier_name", "null", H,
          "po_key is not null and (sid is null or po_supplier_id is null) and coalesce(s_name,'')<>'' and lower(s_name) <> lower(po_supplier_name)"),
    _rule("F21", "0", "po_total_exceeded", "error",
          f"'Invoice total (' || {m('total_cents')} || ') differs from PO total (' || {m('po_total_cents')} || ') by ' || printf('%.1f', abs(total_cents-po_total_cents)/100.0/(greatest(po_total_cents,1)/100.0)*100) || '%'",
          "'total'", m("total_cents"), m("po_total_cents"), "null", H, "po_key is not null and 100*abs(total_cents-po_total_cents) > greatest(po_total_cents,1)"),
    _rule("F26", "0", "supplier_is_internal_entity", "error", "'Supplier identified as internal company (ABN: ' || inv_abn || '). Possible Supplier/Buyer inversion.'",
          "'supplier.name'", "null", "null", "null", H, "variant = 9"),
]
LINE_RULES = [
    _rule("F9", "line_index", "negative_amount", "warning", f"'Line item ' || (line_index+1) || ' has a negative total: ' || {m('line_cents')}",
          "'line_items[' || line_index || '].total'", num("line_cents"), "null", "line_index+1", "lin", "line_cents < 0"),
    _rule("F22", "line_index", "po_line_not_found", "warning", "'Invoice line ' || (line_index+1) || ' (''' || invoice_description || ''') has no matching PO line'",
          "'line_items[' || line_index || ']'", "invoice_description", "null", "line_index+1", "flags", "not matched"),
    _rule("F23", "line_index", "po_line_quantity_mismatch", "warning", "'Line ' || (line_index+1) || ' quantity mismatch vs PO line ' || po_line_number",
          "'line_items[' || line_index || '].quantity'", num("qty*100"), num("po_qty*100"), "po_line_number", "flags", "quantity_matches = false"),
    _rule("F24", "line_index", "po_line_price_mismatch", "error", "'Line ' || (line_index+1) || ' unit price mismatch vs PO line ' || po_line_number",
          "'line_items[' || line_index || '].unit_price'", num("unit_cents"), num("po_unit_cents"), "po_line_number", "flags", "price_matches = false"),
    _rule("F25", "po_pos", "po_line_not_found", "info", "'PO line ' || (po_pos+1) || ' was not found on the invoice (may be a partial delivery)'",
          "'line_items'", "null", "'PO line ' || (po_pos+1)", "po_pos+1", "unbilled", "true"),
]


def _strip_head(sql: str) -> str:
    return sql.split("with recursive ", 1)[1]


def _merge(*texts: str) -> str:
    """One WITH list out of several oracle prefixes; a name defined before is kept."""
    import re

    seen, out = set(), []
    for t in texts:
        body = _strip_head(t) if t.startswith("with recursive ") else t.lstrip(" ,\n")
        for part in re.split(r",\s*\n(?=\s*[a-z_]+ as \()", body):
            name = part.strip().split(" as (", 1)[0]
            if name not in seen:
                seen.add(name)
                out.append(part.strip())
    return "with recursive " + ",\n".join(out)


HD = """
  lsum as (select ok, count(*) as n_lines, sum(line_cents) as lines_cents from lin group by ok),
  hd as (select h.*, case when h.variant<>7 then h.inv_name end as s_name, ls.n_lines, ls.lines_cents, """ + date_sql("h.invoice_date") + " as d, " + date_sql("h.due_date") + """ as due,
     ms.supplier_id as sid, lk.wanted, lk.po_key, lk.po_supplier_id, lk.po_supplier_name, lk.po_total_cents
   from hdr h left join lsum ls on ls.ok=h.ok left join cascade c on c.stem=h.stem left join sup ms on ms.supplier_ord=c.o left join lk on lk.ok=h.ok)"""
UNBILLED = """
  unbilled as (select lk.stem, p.line_number-1 as po_pos from lk join pol p on upper(p.po_number)=lk.po_key
    where not exists (select 1 from chosen c where c.stem=lk.stem and c.po_pos=p.line_number-1))"""

_FLAGS = FLAGS.replace("lcs_pairs", "line_lcs_pairs").replace("lcs_masks", "line_lcs_masks").replace("lcs_scored", "line_lcs_scored")
FULL = _merge(CASCADE, _FLAGS, HD, UNBILLED)
DISC = FULL + ",\ndisc as (" + "\n union all ".join(HEADER_RULES + LINE_RULES) + ")"

PO_ONLY = """
  po as (select upper(po_number) as po_key, po_number, po_supplier_id, subtotal_cents + cast(floor(subtotal_cents/10.0+0.5) as bigint) as po_total_cents,
     s.name as po_supplier_name, n_lines from poh left join sup s on s.supplier_ord=poh.s_suppkey),
  lk as (select h.*, nullif(trim(po_ref),'') as wanted, po.po_key, po.po_supplier_id, po.po_total_cents, po.po_supplier_name, po.n_lines, po.po_number as found_number
     from hdr h left join po on po.po_key=upper(nullif(trim(po_ref),'')))"""
from catalogue.fixture_sql import with_views  # noqa: E402

HEAD = _merge(CASCADE, with_views("hdr", "sup", "poh", "lin"), PO_ONLY, HD)


def run(spark, sf) -> R.Reconciled:
    return R.reconcile(I.invoices(spark, sf), I.lines(spark, sf), I.masters(spark, sf), I.PARAMS)


def header(spark, sf):
    return R.header_review(I.invoices(spark, sf), I.lines(spark, sf), I.masters(spark, sf), I.PARAMS)


NAMES = {
    "F1": "rule_mandatory", "F2": "rule_missing_number", "F3": "rule_missing_date", "F4": "rule_missing_supplier", "F5": "rule_missing_total",
    "F6": "rule_zero_total", "F7": "rule_negative_total", "F8": "rule_missing_lines", "F9": "rule_negative_line", "F10": "rule_lines_subtotal",
    "F11": "rule_tax", "F12": "rule_grand_total", "F13": "rule_future_date", "F14": "rule_old_date", "F15": "rule_overdue",
    "F16": "rule_due_before_invoice", "F17": "rule_supplier_not_found", "F18": "rule_po_not_found", "F19": "rule_po_supplier_id",
    "F20": "rule_po_supplier_name", "F21": "rule_po_total", "F22": "rule_line_not_on_po", "F23": "rule_line_quantity", "F24": "rule_line_price",
    "F25": "rule_po_line_unbilled", "F26": "rule_internal",
}
LINE_LEVEL = ("F9", "F22", "F23", "F24", "F25")
SUPPLIER_LEVEL = ("F17", "F19", "F20")


def _register_rule(rule: str, name: str) -> None:
    text = next(iter(t for t in LINE_RULES if f"'{rule}' as rule" in t), None)
    texts = [text] if text else [t for t in HEADER_RULES if f"'{rule}' as rule" in t]
    prefix = FULL if rule in LINE_LEVEL else HEAD

    @query(name, prefix + "\n" + "\n union all ".join(texts))
    def one_rule(spark, sf):
        # each rule reads only what it needs
        if rule == "F9":
            found = RU.negative_line_findings(I.lines(spark, sf))
        elif rule == "F25":
            found = RU.unbilled_findings(unbilled(spark, sf))
        elif rule in LINE_LEVEL:
            found = RU.match_findings(I_matches(spark, sf))
        else:
            heads = header(spark, sf) if rule in SUPPLIER_LEVEL else header_without_suppliers(spark, sf)
            found = heads.select("stem", F.explode("findings").alias("f"))
        return found.select("stem", "f.*").filter(F.col("rule") == rule).select(*OUT)


def header_without_suppliers(spark, sf):
    return R.header_review_without_suppliers(I.invoices(spark, sf), I.lines(spark, sf), I.masters(spark, sf), I.PARAMS)


def unbilled(spark, sf):
    from catalogue.matching import line_found
    from ledgerloom.operators import orders as O

    return O.unmatched_po_lines(line_found(spark, sf))


def I_matches(spark, sf):
    from catalogue.matching import line_found
    from ledgerloom.operators import orders as O

    return O.line_matches(line_found(spark, sf))


for _r, _n in NAMES.items():
    _register_rule(_r, _n)


@query("discrepancies_long", DISC + " select " + ", ".join(OUT) + " from disc")
def discrepancies_long(spark, sf):
    return run(spark, sf).discrepancies.select(*OUT)


@query("discrepancy_by_type", DISC + " select rule, type, severity, count(*) as n, count(distinct stem) as n_invoices from disc group by 1,2,3")
def discrepancy_by_type(spark, sf):
    return run(spark, sf).discrepancies.groupBy("rule", "type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("n_invoices")
    )


SUMMARY = DISC + """,
 per as (select stem, count_if(severity='error') as e, count_if(severity='warning') as w, count(*) as n from disc group by 1),
 summary as (select h.stem, cast(coalesce(e,0) as bigint) as error_count, cast(coalesce(w,0) as bigint) as warning_count, coalesce(n,0) as discrepancy_count,
   coalesce(e,0)+coalesce(w,0) > 0 as requires_review, case when coalesce(e,0)+coalesce(w,0) > 0 then 'needs_review' else 'ready' end as status,
   total_cents, sid from hd h left join per on per.stem=h.stem)"""


@query("discrepancy_summary", SUMMARY + " select stem, error_count, warning_count, discrepancy_count, requires_review, status from summary")
def discrepancy_summary(spark, sf):
    return run(spark, sf).results.select("stem", "error_count", "warning_count", "discrepancy_count", "requires_review", "status")


@query("review_reasons", DISC + " select distinct stem, description as reason from disc where severity in ('error','warning')")
def review_reasons(spark, sf):
    return RU.review_reasons(run(spark, sf).discrepancies)


@query("batch_summary", SUMMARY + """
 select count(*) as processed, cast(count_if(requires_review) as bigint) as needs_review, cast(sum(error_count) as bigint) as errors, cast(sum(warning_count) as bigint) as warnings from summary""")
def batch_summary(spark, sf):
    return RU_batch(run(spark, sf).results)


def RU_batch(results):
    from ledgerloom.operators.views import batch_totals

    return batch_totals(results)


REVIEW = SUMMARY + """
 select stem, sid as supplier_id, total_cents, error_count, warning_count from summary where requires_review"""


@query("review_queue", REVIEW)
def review_queue(spark, sf):
    """Every invoice that needs review."""
    from ledgerloom.operators.views import review_queue as rq

    return _queue(rq(run(spark, sf).results))


@query("review_top", REVIEW + " order by error_count desc, total_cents desc nulls last, stem limit 100")
def review_top(spark, sf):
    """The hundred most urgent ones."""
    from ledgerloom.operators.views import review_queue as rq

    return _queue(rq(run(spark, sf).results, 100))


def _queue(rows):
    return rows.select(
        "stem", F.col("matched_supplier.supplier_id").alias("supplier_id"), F.floor(F.col("total") * 100).cast("bigint").alias("total_cents"),
        "error_count", "warning_count",
    )
