"""Queries and oracles: corrections, normalised payloads, export texts, re-evaluation, bulk export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.matching import FLAGS, line_found
from catalogue.review import _FLAGS, _merge, CASCADE, DISC
from ledgerloom.operators import export as X
from ledgerloom.operators import orders as O
from ledgerloom.params import MONEY
from ledgerloom.plans import bulk_export as B
from ledgerloom.plans import reevaluate as RE
from ledgerloom.plans.reconcile import match_headers
from ledgerloom.session import shared_dir

QUERIES, ORACLES = {}, {}
AT = "2024-02-01T00:00:00+00:00"
NAME = "Fixed <Name> & Co"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def corrections(spark, sf):
    """Operator corrections by order key: nulling a total, renaming, re-assigning, replacing lines or fields."""
    k = F.col("ok") % 8
    none = F.lit(None).cast("string")
    money = F.lit(None).cast(MONEY)
    item = F.struct(
        F.lit(1).alias("line_number"), none.alias("sku"), F.lit("Replacement").alias("description"), F.lit(2).cast(MONEY).alias("quantity"),
        none.alias("unit"), F.lit(5).cast(MONEY).alias("unit_price"), F.lit(10).cast(MONEY).alias("total"),
    )
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    present = (
        F.when(k == 1, words("total")).when(k == 2, words("supplier_name")).when(k == 3, words("supplier_name", "corrected_supplier_id"))
        .when(k == 4, words("corrected_supplier_id")).when(k == 5, words("line_items")).when(k == 6, words("custom_fields", "invoice_number"))
        .otherwise(F.array().cast("array<string>"))
    )
    return I.view(spark, sf, "hdr").select(
        "stem", present.alias("present"), F.when(k == 6, F.concat(F.lit("FIX-"), F.col("ok").cast("string"))).alias("invoice_number"),
        *[none.alias(c) for c in ("invoice_date", "due_date", "po_number", "currency")], *[money.alias(c) for c in ("subtotal", "tax_amount", "total")],
        F.when(k.isin(2, 3), F.lit(NAME)).alias("supplier_name"),
        *[none.alias(c) for c in ("supplier_abn", "supplier_email", "supplier_phone", "supplier_address")],
        F.when(k == 3, F.lit("SUP-1")).when(k == 4, F.lit("SUP-2")).alias("corrected_supplier_id"),
        F.when(k == 5, F.array(item)).alias("line_items"),
        F.when(k == 6, F.create_map(F.lit("project"), F.lit("PROJ-001"))).alias("custom_fields"),
    )


def stored(spark, sf):
    """Matched invoice headers as they stand in the state."""
    def build():
        h = match_headers(I.invoices(spark, sf), I.masters(spark, sf), I.PARAMS)
        return h.withColumn("processed_at", F.lit("2024-01-31T00:00:00+00:00")).withColumn(
            "error_count", (F.col("ok") % 3)).withColumn("warning_count", F.col("ok") % 4).withColumn(
            "requires_review", F.col("ok") % 3 + F.col("ok") % 4 > 0)

    return I._once(spark, sf, "stored", build)


def stored_matches(spark, sf):
    return I._once(spark, sf, "stored_matches", lambda: O.line_matches(line_found(spark, sf)))


def review_state(spark, sf):
    k = F.col("ok") % 9
    status = F.when(k == 0, "exported").when(k.isin(1, 2, 3), "ready").otherwise("needs_review")
    return I.view(spark, sf, "hdr").select(
        "stem", status.alias("status"), F.when(F.col("ok") % 6 == 0, F.lit("check <this> & that")).alias("notes")
    )


def corrected(spark, sf):
    return X.apply_corrections(stored(spark, sf), corrections(spark, sf))


FIX = "'Fixed <Name> & Co'"
CH = """
  ch as (select h.*, h.ok%8 as k, h.ok%8 between 1 and 6 as has_corr,
     case when h.ok%8=1 then null else h.total_cents end as total2, case when h.ok%8=6 then 'FIX-' || h.ok else h.invoice_number end as number2,
     case when h.ok%8 in (2,3) then """ + FIX + """ when h.variant<>7 then h.inv_name end as name2,
     case when h.variant<>7 and h.ok%2=0 then '1 Main St' end as address,
     case h.ok%8 when 3 then 'SUP-1' when 4 then 'SUP-2' else m.supplier_id end as sid2,
     case h.ok%8 when 3 then """ + FIX + """ when 4 then coalesce(m.name, case when h.variant<>7 then h.inv_name end) else m.name end as mname2,
     case when h.ok%8 in (3,4) then 'operator_override' else c.match_method end as method2, c.match_method, c.confidence, m.abn as mabn, m.supplier_id as sid, m.name as mname,
     case when h.ok%6=0 then 'check <this> & that' end as notes
   from hdr h left join cascade c on c.stem=h.stem left join sup m on m.supplier_ord=c.o)"""
CORR = _merge(CASCADE, CH)


@query("apply_corrections", CORR + """
 select stem, number2 as invoice_number, total2 as total_cents, name2 as supplier_name, sid2 as supplier_id, mname2 as matched_name, method2 as match_method,
  case when k=6 then 'PROJ-001' end as project from ch""")
def apply_corrections(spark, sf):
    return corrected(spark, sf).select(
        "stem", "invoice_number", F.floor(F.col("total") * 100).cast("bigint").alias("total_cents"), F.col("supplier.name").alias("supplier_name"),
        F.col("matched_supplier.supplier_id").alias("supplier_id"), F.col("matched_supplier.supplier_name").alias("matched_name"),
        F.col("matched_supplier.match_method").alias("match_method"), F.try_element_at("custom_fields", F.lit("project")).alias("project"),
    )


NORM = CORR + """,
  norm as (select stem, ok, case when k in (3,4) or sid is not null then sid2 end as id,
    case when k in (3,4) then coalesce(nullif(mname2,''), name2) when sid is not null then mname else name2 end as name,
    case when k in (3,4) or sid is not null then coalesce(mabn, inv_abn) else inv_abn end as abn, inv_acn as acn, inv_email as email, address,
    case when k in (3,4) then 'corrected' when sid is not null then 'matched' else 'extracted' end as source,
    case when k in (3,4) or sid is not null then confidence end as match_confidence,
    case when k in (3,4) then 'operator_override' else match_method end as match_method,
    case when k not in (3,4) then case match_method when 'abn_exact' then 'abn' when 'name_exact' then 'name' when 'name_fuzzy' then 'name' when 'email_domain' then 'email_domain' end end as on_field,
    case when k not in (3,4) then case match_method when 'abn_exact' then coalesce(nullif(inv_abn,''),inv_acn) when 'name_exact' then name2 when 'name_fuzzy' then name2
       when 'email_domain' then split_part(inv_email,'@',2) end end as on_value from ch)"""


@query("normalised_supplier", NORM + " select stem, id, name, abn, acn, email, address, source, match_confidence, match_method, on_field, on_value from norm")
def normalised_supplier(spark, sf):
    n = corrected(spark, sf).select("stem", X.normalised_supplier().alias("n"))
    return n.select("stem", *[F.col(f"n.{c}").alias(c) for c in ("id", "name", "abn", "acn", "email", "address", "source", "match_confidence", "match_method")],
                    F.col("n.matched_on.field").alias("on_field"), F.col("n.matched_on.value").alias("on_value"))


def norm_lines(spark, sf):
    return X.normalised_lines(X.corrected_lines(I.lines(spark, sf), corrections(spark, sf)), stored_matches(spark, sf))


CLINES = """
  cl as (select ok, stem, line_index, line_index+1 as line_number, description, sku, cast(qty as double) as quantity, cast(unit_cents as double)/100 as unit_price,
      cast(line_cents as double)/100 as line_total from lin where ok%8<>5
    union all select ok, stem, 0, 1, 'Replacement', null, 2.0, 5.0, 10.0 from hdr where ok%8=5),
  nl as (select cl.*, f.matched, f.po_line_number, f.po_description, f.match_score, f.quantity_matches, f.price_matches, f.total_matches from cl left join flags f on f.stem=cl.stem and f.line_index=cl.line_index)"""
LINES = _merge(FLAGS, CLINES)


@query("normalised_lines", LINES + " select stem, line_index, line_number, description, sku, quantity, unit_price, line_total, matched, po_line_number, quantity_matches from nl")
def normalised_lines(spark, sf):
    return norm_lines(spark, sf).select("stem", "line_index", "line_number", "description", "sku", "quantity", "unit_price", "line_total",
                                        F.col("po_match.matched").alias("matched"), F.col("po_match.po_line_number").alias("po_line_number"),
                                        F.col("po_match.quantity_matches").alias("quantity_matches"))


GATE = CORR + """, gate as (select stem, list_filter([case when coalesce(trim(invoice_date)='',true) then 'invoice_date' end, case when coalesce(trim(number2)='',true) then 'invoice_number' end,
   case when coalesce(trim(name2)='',true) then 'supplier.name' end, case when total2 is null then 'total' end], lambda x: x is not null) as missing, ok from ch)"""


@query("mandatory_gate", GATE + " select stem, array_to_string(missing, ',') as missing, len(missing)=0 as exportable from gate")
def mandatory_gate(spark, sf):
    g = X.mandatory_gate(corrected(spark, sf), I.PARAMS)
    return g.select("stem", F.array_join("missing", ",").alias("missing"), "exportable")


def payloads(spark, sf, mode="single"):
    inv = corrected(spark, sf).join(review_state(spark, sf).select("stem", "notes"), "stem", "left")
    return X.payloads(inv, norm_lines(spark, sf), F.lit(AT), mode)


PAY = _merge(CASCADE, _FLAGS, CLINES, CH, NORM.split("norm as (", 1)[1].join(["  norm as (", ""]))
PAY_SUM = PAY + ", per as (select stem, count(*) as n, sum(line_total) as s from nl group by 1)"


def _pay_columns(mode: str) -> str:
    return "cast(ok%3 as bigint) as error_count" if mode == "bulk" else "number2 as invoice_number"


for _mode in ("single", "bulk"):
    def _register(mode: str) -> None:
        name = "export_payload" if mode == "single" else "export_payload_bulk"

        @query(name, PAY_SUM + f"""
 select c.stem, '{AT}' as exported_at, c.stem || '.pdf' as pdf_file, has_corr as corrections_applied, notes, n.source, n.name, coalesce(per.n,0) as n_lines,
   cast(total2 as double)/100 as total, sid2 as matched_id, {_pay_columns(mode).replace('ok%3', 'c.ok%3')} from ch c join norm n on n.stem=c.stem left join per on per.stem=c.stem""")
        def payload_query(spark, sf):
            p = payloads(spark, sf, mode)
            extra = F.col("payload.error_count").cast("bigint").alias("error_count") if mode == "bulk" else F.col("payload.invoice_number").alias("invoice_number")
            return p.select(
                "stem", F.col("payload.exported_at").alias("exported_at"), F.col("payload.pdf_file").alias("pdf_file"),
                F.col("payload.corrections_applied").alias("corrections_applied"), F.col("payload.operator_notes").alias("notes"),
                F.col("payload.supplier.source").alias("source"), F.col("payload.supplier.name").alias("name"),
                F.size("payload.line_items").cast("bigint").alias("n_lines"), F.col("payload.extracted_invoice.total").alias("total"),
                F.col("payload.matched_supplier.supplier_id").alias("matched_id"), extra,
            )

    _register(_mode)

JLINES = """, jl as (select stem, list({'line_number': line_number, 'description': description, 'quantity': quantity, 'unit_price': unit_price, 'line_total': line_total,
   'po_match': case when matched is null then null else {'matched': matched, 'po_line_number': po_line_number, 'po_description': case when matched then po_description end,
     'match_score': cast(match_score as double), 'quantity_matches': quantity_matches, 'price_matches': price_matches, 'total_matches': total_matches} end} order by line_index) as items from nl group by 1)"""


@query("webhook_payload", PAY + JLINES + f"""
 select c.stem, cast(to_json({{'event': 'invoice_exported', 'timestamp': '{AT}', 'stem': c.stem, 'invoice_number': coalesce(number2,''), 'invoice_date': coalesce(invoice_date,''), 'due_date': coalesce(due_date,''),
   'po_number': coalesce(po_ref,''), 'currency': 'AUD', 'subtotal': cast(subtotal_cents as double)/100, 'tax_amount': cast(tax_cents as double)/100, 'total': coalesce(cast(total2 as double)/100, 0.0),
   'supplier': {{'id': coalesce(n.id,''), 'name': coalesce(n.name,''), 'abn': coalesce(n.abn,''), 'email': coalesce(n.email,''), 'source': n.source}},
   'line_items': coalesce(items, []), 'metadata': {{'corrections_applied': has_corr, 'operator_notes': coalesce(notes,''), 'processed_at': '2024-01-31T00:00:00+00:00'}}, 'pdf_attachment': null}}) as varchar) as body
 from ch c join norm n on n.stem=c.stem left join jl on jl.stem=c.stem""")
def webhook_payload(spark, sf):
    return payloads(spark, sf).select("stem", X.webhook_event().alias("body"))


@query("dms_payload", PAY + """
 select c.stem, '{"CategoryNo":57,"CheckInComments":"Created by invoice export for ' || c.stem || '","IndexDataItems":['
  || '{"StringIndexData":{"FieldName":"Invoice_No","FieldNo":0,"DataValue":' || coalesce('"' || number2 || '"','null') || '}},'
  || '{"DateIndexData":{"FieldName":"Invoice_Date","FieldNo":0,"DataISO8601Value":' || coalesce('"' || invoice_date || '"','null') || '}},'
  || '{"MoneyIndexData":{"FieldName":"Total_Gross","FieldNo":0,"DecimalDataValue":' || cast(coalesce(cast(total2 as double)/100,0.0::double) as varchar) || '}},'
  || '{"StringIndexData":{"FieldName":"Supplier","FieldNo":0,"DataValue":' || coalesce('"' || n.name || '"','null') || '}},'
  || '{"StringIndexData":{"FieldName":"PO_No","FieldNo":0,"DataValue":"' || coalesce(po_ref,'') || '"}}],"Streams":[],"DoFillDependentFields":true}' as body
 from ch c join norm n on n.stem=c.stem""")
def dms_payload(spark, sf):
    return payloads(spark, sf).select("stem", X.dms_event().alias("body"))


def esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&#34;'),'''','&#39;')"


def el(name: str, c: str) -> str:
    return f"coalesce('<{name}>' || {esc(f'nullif({c},{chr(39)*2})')} || '</{name}>', '')"


def numx(name: str, cents: str) -> str:
    return el(name, f"regexp_replace(cast(cast(({cents})/100.0 as decimal(18,4)) as varchar), '0{{1,3}}$', '')")


@query("export_xml", PAY + """, xl as (select stem, string_agg('<LineItem number="' || line_number || '">' || """ + el("Description", "description") + " || " + el("SKU", "sku") + " || "
       + numx("Quantity", "quantity*100") + " || " + numx("UnitPrice", "unit_price*100") + " || " + numx("LineTotal", "line_total*100") + """ || '</LineItem>', '' order by line_index) as items from nl group by 1)
 select c.stem, '<?xml version="1.0" encoding="UTF-8"?><Invoice><Meta>' || """ + el("Stem", "c.stem") + f" || '<ExportedAt>{AT}</ExportedAt>' || " + el("PdfFile", "c.stem || '.pdf'")
       + " || '<CorrectionsApplied>' || cast(has_corr as varchar) || '</CorrectionsApplied>' || " + el("OperatorNotes", "notes") + " || '</Meta><Supplier>' || " + el("Id", "sid2")
       + " || '<Name>' || " + esc("coalesce(nullif(mname2,''), name2, '')") + " || '</Name>' || " + el("ABN", "inv_abn") + " || " + el("ACN", "inv_acn") + " || " + el("Email", "inv_email")
       + " || " + el("Address", "address") + " || " + el("MatchMethod", "method2") + " || '</Supplier><InvoiceDetails>' || " + el("InvoiceNumber", "number2") + " || " + el("InvoiceDate", "invoice_date")
       + " || " + el("DueDate", "due_date") + " || " + el("PONumber", "po_ref") + " || '<Currency>AUD</Currency>' || " + numx("Subtotal", "subtotal_cents") + " || " + numx("TaxAmount", "tax_cents") + " || "
       + numx("Total", "total2") + """ || '</InvoiceDetails>' || coalesce('<LineItems>' || items || '</LineItems>','')
  || case when k=6 then '<CustomFields><Field name="project">PROJ-001</Field></CustomFields>' when ok%3=0 then '<CustomFields><Field name="bsb">123-' || lpad(cast(ok%1000 as varchar),3,'0') || '</Field></CustomFields>' else '' end
  || '</Invoice>' as body from ch c left join xl on xl.stem=c.stem""")
def export_xml(spark, sf):
    return payloads(spark, sf).select("stem", X.xml_document().alias("body"))


@query("export_files", "select body from (" + ORACLES["export_xml"] + ")")
def export_files(spark, sf):
    """The same documents written to files, twice under one run id (as after a crash), and read back."""
    path = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    for _ in range(2):
        X.write_exports(payloads(spark, sf), path, "run-1", "xml")
    return spark.read.text(f"{path}/xml").select(F.col("value").alias("body"))


BULK = GATE + """, st as (select *, case ok%9 when 0 then 'exported' when 1 then 'ready' when 2 then 'ready' when 3 then 'ready' else 'needs_review' end as status from gate)"""


@query("bulk_export_plan", BULK + " select stem, 'exported' as status, cast(null as varchar) as error from st where status='ready'")
def bulk_export_plan(spark, sf):
    go, refused = B.plan_bulk(review_state(spark, sf), corrected(spark, sf), I.PARAMS)
    events = B.exported_events(go.select("stem"), F.lit(AT).cast("timestamp"), "json", 0, "run-1")
    none = F.lit(None).cast("string")
    return events.select("stem", "status", none.alias("error")).unionByName(refused.select("stem", none.alias("status"), "error"))


@query("bulk_export_gated", BULK + """ select stem, len(missing)=0 as exported, case when len(missing)>0 then 'Missing mandatory fields: ' || array_to_string(missing, ', ') end as error from st where status='ready'""")
def bulk_export_gated(spark, sf):
    go, refused = B.plan_bulk(review_state(spark, sf), corrected(spark, sf), I.PARAMS, gate=True)
    return go.select("stem", F.lit(True).alias("exported"), F.lit(None).cast("string").alias("error")).unionByName(
        refused.select("stem", F.lit(False).alias("exported"), "error"))


def _wrap_cte(sql: str, name: str, replacement: str) -> str:
    """Rename CTE ``name`` to ``name0`` and define ``name`` on top of it."""
    head, tail = sql.split(f"\n{name} as (", 1)
    depth, i = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(tail[i], 0)
        i += 1
    return f"{head}\n{name}0 as ({tail[:i]},\n{name} as ({replacement}){tail[i:]}"


def _reevaluation_sql() -> str:
    """The rule SQL over corrected headers and lines of the invoices that are not exported."""
    sql = _wrap_cte(DISC, "hdr", """select * replace (case when ok%8=1 then null else total_cents end as total_cents, case when ok%8=6 then 'FIX-' || ok else invoice_number end as invoice_number,
     case when ok%8 in (2,3) then 'Fixed <Name> & Co' else inv_name end as inv_name, case when variant=7 and ok%8 in (2,3) then 100 else variant end as variant) from hdr0 where ok%9<>0""")
    return _wrap_cte(sql, "lin", """select * from lin0 where ok%8<>5 and ok%9<>0 union all
  select ok, stem, 0, null, 'Replacement', 2, 500, 1000, 1000, false from hdr0 where ok%8=5 and ok%9<>0""")


@query("reevaluate", _reevaluation_sql() + """,
 per as (select stem, count_if(severity='error') as e, count_if(severity='warning') as w from disc group by 1)
 select h.stem, cast(coalesce(e,0) as bigint) as error_count, cast(coalesce(w,0) as bigint) as warning_count,
  case when coalesce(e,0)+coalesce(w,0) > 0 then 'needs_review' when h.ok%9 in (1,2,3) then 'ready' else 'needs_review' end as status
 from hdr h left join per on per.stem=h.stem""")
def reevaluate(spark, sf):
    from ledgerloom.operators.state import accept_changes

    st = review_state(spark, sf)
    allowed, _ = accept_changes(I.invoices(spark, sf), st)
    r = RE.reevaluate(allowed, I.lines(spark, sf), corrections(spark, sf), I.masters(spark, sf), I.PARAMS)
    return RE.reevaluated_status(r.results, st).select("stem", "error_count", "warning_count", "status")
