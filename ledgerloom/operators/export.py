"""Operator corrections, normalised payloads and export texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import plain_number, truthy
from ledgerloom.operators.rules import field_value, is_missing
from ledgerloom.params import Params

# Correction keys that overwrite invoice fields and supplier fields.
INVOICE_KEYS = ("invoice_number", "invoice_date", "due_date", "po_number", "currency", "subtotal", "tax_amount", "total")
SUPPLIER_KEYS = {
    "supplier_name": "name", "supplier_abn": "abn", "supplier_email": "email", "supplier_phone": "phone", "supplier_address": "address",
}


def _has(key: str) -> Column:
    """A key that is present overwrites even with null."""
    return F.coalesce(F.array_contains("corr.present", key), F.lit(False))


def apply_corrections(invoices: DataFrame, corrections: DataFrame) -> DataFrame:
    """``invoices`` (with ``matched_supplier``) under ``corrections(stem, present, <keys>)``.

    ``corr`` stays on the row (null without corrections) for the normalised supplier.
    """
    corr = corrections.filter(F.size("present") > 0)
    joined = invoices.join(
        corr.select("stem", F.struct(*[c for c in corr.columns if c != "stem"]).alias("corr")), "stem", "left"
    )
    any_ = F.col("corr").isNotNull()
    out = joined
    for key in INVOICE_KEYS:
        out = out.withColumn(key, F.when(_has(key), F.col(f"corr.{key}")).otherwise(F.col(key)))
    parts = [f.name for f in invoices.schema["supplier"].dataType.fields]
    by_field = {v: k for k, v in SUPPLIER_KEYS.items()}
    supplier = F.struct(*[
        (F.when(_has(by_field[p]), F.col(f"corr.{by_field[p]}")).otherwise(F.col(f"supplier.{p}")) if p in by_field else F.col(f"supplier.{p}")).alias(p)
        for p in parts
    ])
    out = out.withColumn("supplier", F.when(any_ | F.col("supplier").isNotNull(), supplier))
    out = out.withColumn("custom_fields", F.when(_has("custom_fields"), F.col("corr.custom_fields")).otherwise(F.col("custom_fields")))
    if "matched_supplier" not in invoices.columns:
        return out
    ms = "matched_supplier"
    name = F.coalesce(truthy(F.col("corr.supplier_name")), truthy(F.col(f"{ms}.supplier_name")), F.col("supplier.name"))
    override = F.struct(
        F.col("corr.corrected_supplier_id").alias("supplier_id"), name.alias("supplier_name"), F.lit("operator_override").alias("match_method"),
        *[F.col(f"{ms}.{c}").alias(c) for c in ("confidence", "abn", "matched_on")],
    )
    return out.withColumn(ms, F.when(_has("corrected_supplier_id"), override).otherwise(F.col(ms)))


def corrected_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with corrected ``line_items`` get exactly those lines; the rest keep theirs."""
    replaced = corrections.filter(F.array_contains("present", "line_items"))
    new = replaced.select("stem", F.posexplode("line_items").alias("line_index", "li"))
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    have = {f.name for f in corrections.schema["line_items"].dataType.elementType.fields}
    fresh = new.select(*[
        F.col("stem") if c == "stem"
        else F.col("line_index").cast("bigint").alias(c) if c == "line_index"
        else (F.col(f"li.{c}") if c in have else F.lit(None)).cast(kinds[c]).alias(c)
        for c in lines.columns
    ])
    return lines.join(replaced.select("stem"), "stem", "left_anti").unionByName(fresh)


def normalised_supplier(corrected: bool = True) -> Column:
    """One supplier struct from correction, match and extraction, with its ``source``."""
    s, m = "supplier.", "matched_supplier."
    corr = (lambda k: truthy(F.col(f"corr.{k}"))) if corrected else (lambda k: F.lit(None).cast("string"))
    method, null = F.col(m + "match_method"), F.lit(None).cast("string")
    ext = {k: F.col(s + k) for k in ("name", "abn", "acn", "email", "phone", "address")}

    def on(field: str, value: Column, fuzzy: Column | None = None) -> Column:
        score = F.lit(None).cast("double") if fuzzy is None else fuzzy
        return F.struct(F.lit(field).alias("field"), value.alias("value"), score.alias("fuzzy_score"))

    after_at = F.when(F.contains(ext["email"], F.lit("@")), F.split_part(ext["email"], F.lit("@"), F.lit(2)))
    matched_on = (
        F.when(method == "abn_exact", on("abn", F.coalesce(truthy(ext["abn"]), ext["acn"])))
        .when(method == "name_exact", on("name", ext["name"]))
        .when(method == "name_fuzzy", on("name", ext["name"], F.col(m + "confidence")))
        .when(method == "email_domain", on("email_domain", after_at))
    )

    def first(*cs: Column) -> Column:
        """First non-empty value, else the last one."""
        return F.coalesce(*[truthy(c) for c in cs[:-1]], cs[-1])

    def built(id_, name, abn, email, phone, address, source, confidence, how, detail) -> Column:
        return F.struct(
            id_.alias("id"), name.alias("name"), abn.alias("abn"), ext["acn"].alias("acn"), email.alias("email"), phone.alias("phone"),
            address.alias("address"), F.lit(source).alias("source"), confidence.cast("double").alias("match_confidence"),
            how.alias("match_method"), detail.alias("matched_on"),
        )

    no_detail = F.when(F.lit(False), on("abn", null))
    by_hand = built(
        corr("corrected_supplier_id"), first(corr("supplier_name"), F.col(m + "supplier_name"), ext["name"]),
        first(corr("supplier_abn"), F.col(m + "abn"), ext["abn"]), first(corr("supplier_email"), ext["email"]),
        first(corr("supplier_phone"), ext["phone"]), first(corr("supplier_address"), ext["address"]),
        "corrected", F.col(m + "confidence"), F.lit("operator_override"), no_detail,
    )
    by_match = built(
        F.col(m + "supplier_id"), first(F.col(m + "supplier_name"), ext["name"]), first(F.col(m + "abn"), ext["abn"]),
        ext["email"], ext["phone"], ext["address"], "matched", F.col(m + "confidence"), method, matched_on,
    )
    bare = built(null, ext["name"], ext["abn"], ext["email"], ext["phone"], ext["address"], "extracted", F.lit(None), null, no_detail)
    return F.when(corr("corrected_supplier_id").isNotNull(), by_hand).when(truthy(F.col(m + "supplier_id")).isNotNull(), by_match).otherwise(bare)


def normalised_lines(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Long form: one row per invoice line with its order match or null."""
    po = matches.select(
        "stem", "line_index",
        F.struct("matched", "po_line_number", "po_description", "match_score", "quantity_matches", "price_matches", "total_matches").alias("po_match"),
    )
    number = F.coalesce(F.nullif(F.col("line_number").cast("bigint"), F.lit(0)), F.col("line_index") + 1)
    return lines.join(po, ["stem", "line_index"], "left").select(
        "stem", "line_index", number.alias("line_number"), "description", "sku",
        F.col("quantity").cast("double").alias("quantity"), "unit", F.col("unit_price").cast("double").alias("unit_price"),
        F.col("total").cast("double").alias("line_total"), F.lit(None).cast("double").alias("tax_amount"), "po_match",
    )


def nested_lines(normalised: DataFrame) -> DataFrame:
    """(stem, line_items): an export payload is one value per document, so its lines meet here."""
    cols = [c for c in normalised.columns if c not in ("stem",)]
    return normalised.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("line_items"))


def missing_mandatory(invoices: DataFrame, params: Params) -> Column:
    """Names of visible mandatory fields without a value."""
    names = [f for f in params.mandatory_fields if f not in params.hidden_fields]
    checks = F.array(*[F.when(is_missing(field_value(f, invoices.columns)), F.lit(f)) for f in names])
    return F.filter(checks, lambda x: x.isNotNull())


def mandatory_gate(invoices: DataFrame, params: Params) -> DataFrame:
    """Adds ``missing`` and ``exportable``."""
    return invoices.withColumn("missing", missing_mandatory(invoices, params)).withColumn("exportable", F.size("missing") == 0)


def payloads(invoices: DataFrame, lines: DataFrame, exported_at: Column, mode: str = "single") -> DataFrame:
    """(stem, payload struct). ``single`` flattens the invoice fields, ``bulk`` the result's fields.

    ``invoices`` is the output of ``apply_corrections`` with ``notes``; ``lines`` of ``normalised_lines``.
    """
    full = invoices.join(nested_lines(lines), "stem", "left").withColumn("norm", normalised_supplier())
    money = lambda c: F.col(c).cast("double").alias(c)
    invoice = [
        F.col("invoice_number"), F.col("invoice_date"), F.col("due_date"), F.col("po_number"), F.col("currency"),
        money("subtotal"), money("tax_amount"), money("total"), F.col("custom_fields"),
    ]
    extracted = F.struct(*invoice, F.col("supplier"))
    meta = [
        F.col("stem"), exported_at.alias("exported_at"), F.concat("stem", F.lit(".pdf")).alias("pdf_file"),
        F.col("corr").isNotNull().alias("corrections_applied"), F.col("notes").alias("operator_notes"),
        F.col("processed_at"), F.col("norm").alias("supplier"),
        F.coalesce("line_items", F.array().cast(full.schema["line_items"].dataType)).alias("line_items"),
    ]
    flat = invoice if mode == "single" else [F.col("error_count"), F.col("warning_count"), F.col("requires_review")]
    nested = [extracted.alias("extracted_invoice"), F.col("matched_supplier"), F.col("matched_po")]
    return full.select("stem", F.struct(*meta, *flat, *nested).alias("payload"))


def to_json_text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


# Names of the event, index and record fields in the layouts below.
def webhook_event(payload: str = "payload") -> Column:
    """The standard event layout."""
    p = payload + "."
    inv = p + "extracted_invoice."
    empty, zero = F.lit(""), F.lit(0.0)
    return to_json_text(F.struct(
        F.lit("invoice_exported").alias("event"), F.col(p + "exported_at").alias("timestamp"), F.col(p + "stem").alias("stem"),
        *[F.coalesce(inv + k, empty).alias(k) for k in ("invoice_number", "invoice_date", "due_date", "po_number")],
        F.coalesce(inv + "currency", F.lit("USD")).alias("currency"),
        *[F.coalesce(inv + k, zero).alias(k) for k in ("subtotal", "tax_amount", "total")],
        F.struct(*[F.coalesce(f"{p}supplier.{k}", empty).alias(k) for k in ("id", "name", "abn", "email")], F.col(p + "supplier.source").alias("source")).alias("supplier"),
        F.transform(p + "line_items", lambda i: F.struct(
            i["line_number"].alias("line_number"), i["description"].alias("description"),
            *[F.coalesce(i[k], zero).alias(k) for k in ("quantity", "unit_price", "line_total")], i["po_match"].alias("po_match"),
        )).alias("line_items"),
        F.struct(F.col(p + "corrections_applied").alias("corrections_applied"), F.coalesce(p + "operator_notes", empty).alias("operator_notes"),
                 F.col(p + "processed_at").alias("processed_at")).alias("metadata"),
        F.lit(None).cast("string").alias("pdf_attachment"),
    ))


# The default category number and comment, and the index names.
def dms_event(payload: str = "payload", category_no: int = 57, comment: str = "Created by invoice export for ") -> Column:
    """The document-management layout: index fields by type."""
    inv = f"{payload}.extracted_invoice."

    def index(kind: str, name: str, value_key: str, value: Column) -> Column:
        body = F.struct(F.lit(name).alias("FieldName"), F.lit(0).alias("FieldNo"), value.alias(value_key))
        return to_json_text(F.struct(body.alias(kind)))

    items = F.concat_ws(
        ",",
        index("StringIndexData", "Invoice_No", "DataValue", F.col(inv + "invoice_number")),
        index("DateIndexData", "Invoice_Date", "DataISO8601Value", F.col(inv + "invoice_date")),
        index("MoneyIndexData", "Total_Gross", "DecimalDataValue", F.coalesce(inv + "total", F.lit(0.0))),
        index("StringIndexData", "Supplier", "DataValue", F.col(f"{payload}.supplier.name")),
        index("StringIndexData", "PO_No", "DataValue", F.coalesce(inv + "po_number", F.lit(""))),
    )
    head = to_json_text(F.struct(F.lit(category_no).alias("CategoryNo"), F.concat(F.lit(comment), f"{payload}.stem").alias("CheckInComments")))
    return F.concat(F.rtrim(head, F.lit("}")), F.lit(',"IndexDataItems":['), items, F.lit('],"Streams":[],"DoFillDependentFields":true}'))


def xml_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _element(name: str, value: Column) -> Column:
    """An element, or nothing for a null or empty value."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escape(truthy(value)), F.lit(f"</{name}>")), F.lit(""))


def _number(name: str, value: Column) -> Column:
    return _element(name, plain_number(value))


# The element names of the layout and their order.
def xml_document(payload: str = "payload") -> Column:
    """The shipped XML layout; empty elements are omitted, numbers kept when not null."""
    p, inv, sup, ms = (payload + x for x in (".", ".extracted_invoice.", ".extracted_invoice.supplier.", ".matched_supplier."))
    c = F.col
    meta = F.concat(
        F.lit("<Meta>"), _element("Stem", c(p + "stem")), _element("ExportedAt", c(p + "exported_at")), _element("PdfFile", c(p + "pdf_file")),
        _element("CorrectionsApplied", c(p + "corrections_applied").cast("string")), _element("OperatorNotes", c(p + "operator_notes")), F.lit("</Meta>"),
    )
    shown = F.coalesce(truthy(c(ms + "supplier_name")), c(sup + "name"), F.lit(""))
    supplier = F.concat(
        F.lit("<Supplier>"), _element("Id", c(ms + "supplier_id")), F.lit("<Name>"), xml_escape(shown), F.lit("</Name>"),
        *[_element(tag, c(sup + k)) for tag, k in (("ABN", "abn"), ("ACN", "acn"), ("Email", "email"), ("Phone", "phone"), ("Address", "address"))],
        _element("MatchMethod", c(ms + "match_method")), F.lit("</Supplier>"),
    )
    details = F.concat(
        F.lit("<InvoiceDetails>"),
        *[_element(tag, c(inv + k)) for tag, k in (("InvoiceNumber", "invoice_number"), ("InvoiceDate", "invoice_date"), ("DueDate", "due_date"),
                                                   ("PONumber", "po_number"), ("Currency", "currency"))],
        *[_number(tag, c(inv + k)) for tag, k in (("Subtotal", "subtotal"), ("TaxAmount", "tax_amount"), ("Total", "total"))],
        F.lit("</InvoiceDetails>"),
    )
    items = F.array_join(F.transform(p + "line_items", lambda i: F.concat(
        F.lit('<LineItem number="'), i["line_number"].cast("string"), F.lit('">'), _element("Description", i["description"]), _element("SKU", i["sku"]),
        _number("Quantity", i["quantity"]), _number("UnitPrice", i["unit_price"]), _number("LineTotal", i["line_total"]), F.lit("</LineItem>"),
    )), "")
    lines = F.when(F.size(p + "line_items") > 0, F.concat(F.lit("<LineItems>"), items, F.lit("</LineItems>"))).otherwise(F.lit(""))
    fields = F.array_join(F.transform(F.map_entries(inv + "custom_fields"), lambda e: F.concat(
        F.lit('<Field name="'), xml_escape(e["key"]), F.lit('">'), xml_escape(F.coalesce(e["value"], F.lit(""))), F.lit("</Field>"))), "")
    custom = F.when(F.size(inv + "custom_fields") > 0, F.concat(F.lit("<CustomFields>"), fields, F.lit("</CustomFields>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><Invoice>'), meta, supplier, details, lines, custom, F.lit("</Invoice>"))


def write_exports(payloads_: DataFrame, path: str, run_id: str, fmt: str = "json") -> None:
    """One text row per invoice, by export day, in a folder of the run: writing a run again replaces its files."""
    text = to_json_text(F.col("payload")) if fmt == "json" else xml_document()
    day = F.substring(F.col("payload.exported_at"), 1, 10).alias("export_day")
    payloads_.select(text.alias("value"), day).write.mode("overwrite").partitionBy("export_day").text(f"{path}/{fmt}/run={run_id}")
