"""Invoice construction: responses to typed tables, computed totals, custom fields, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import blank_to_null, clean_response, digits_only, round2, strip, truthy
from ledgerloom.params import MONEY, CustomField

_S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


_AMOUNT = T.DecimalType(18, 4)
LINE_SCHEMA = T.StructType(
    [T.StructField("line_number", T.IntegerType())]
    + [T.StructField(n, _S) for n in ("sku", "description")]
    + [T.StructField("quantity", _AMOUNT), T.StructField("unit", _S), T.StructField("unit_price", _AMOUNT)]
    + [T.StructField("discount", T.DecimalType(9, 6)), T.StructField("total", _AMOUNT)]
)
RESPONSE_SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("invoice_number", "invoice_date", "due_date")]
    + [T.StructField("supplier", _struct("name", "abn", "acn", "address", "email", "phone", "website"))]
    + [T.StructField("bill_to", _struct("name", "address", "email", "contact"))]
    + [T.StructField(n, _S) for n in ("po_number", "reference")]
    + [T.StructField("line_items", T.ArrayType(LINE_SCHEMA))]
    + [T.StructField("subtotal", _AMOUNT), T.StructField("tax_rate", T.DoubleType())]
    + [T.StructField(n, _AMOUNT) for n in ("tax_amount", "shipping", "other_charges", "total")]
    + [T.StructField(n, _S) for n in ("currency", "payment_terms", "bank_details", "notes")]
    + [T.StructField("custom_fields", T.MapType(_S, _S)), T.StructField("_corrupt", _S)]
)


def fill_computed_totals(lines: DataFrame) -> DataFrame:
    """quantity x unit price (less discount) where the total is missing; flags the row."""
    gross = round2(F.col("quantity") * F.col("unit_price"))
    off = F.col("discount")
    net = F.when(F.coalesce(off, F.lit(0)) != 0, round2(gross * (F.lit(1).cast("decimal(9,6)") - off))).otherwise(gross)
    missing = F.col("total").isNull() & net.isNotNull()
    return lines.withColumn("total_computed", F.coalesce("total_computed", F.lit(False)) | missing).withColumn(
        "total", F.coalesce("total", net)
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """``responses(stem, response)`` with parsed column ``r``; null where no clean JSON object was found."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # exploded from an array of one: conditions on ``r`` then read the parsed value, where a projected one would be parsed again for each of them
    one = F.array(F.from_json(clean_response(F.col("response")), RESPONSE_SCHEMA, options))
    parsed = responses.select("*", F.explode_outer(one).alias("__r"))
    return parsed.select(*responses.columns, F.when(F.col("__r._corrupt").isNull(), F.col("__r")).alias("r"))


def response_invoices(parsed: DataFrame) -> DataFrame:
    """Header rows of the parsed responses."""
    fields = [f.name for f in RESPONSE_SCHEMA if f.name not in ("line_items", "_corrupt", "currency", "custom_fields")]
    return parsed.filter("r is not null").select(
        "stem", *[F.col(f"r.{n}").alias(n) for n in fields],
        F.coalesce("r.currency", F.lit("AUD")).alias("currency"),
        F.coalesce("r.custom_fields", F.create_map().cast("map<string,string>")).alias("custom_fields"),
    )


def response_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter("r is not null").select("stem", F.posexplode("r.line_items").alias("line_index", "li")).select(
        "stem", F.col("line_index").cast("bigint").alias("line_index"),
        *[F.col(f"li.{n}").alias(n) for n in ("line_number", "sku", "description", "unit", "quantity", "unit_price", "discount", "total")],
        F.lit(False).alias("total_computed"),
    )


def amount_failures(lines: DataFrame) -> DataFrame:
    """Documents with a line whose quantity x price is out of range, with the first such line as the reason."""
    gross = F.col("quantity") * F.col("unit_price")
    bad = lines.filter(F.col("total").isNull() & gross.isNotNull() & round2(gross).isNull())
    return bad.groupBy("stem").agg(F.min("line_index").alias("i")).select(
        "stem", F.concat(F.lit("amount out of range in line item "), (F.col("i") + 1).cast("string")).alias("error")
    )


def parse_failures(parsed: DataFrame) -> DataFrame:
    """Documents whose response holds no usable JSON object."""
    return parsed.filter("r is null").select("stem", F.lit("response is not a valid JSON object").alias("error"))


def merge_lines(table_lines: DataFrame, response_lines_: DataFrame) -> DataFrame:
    """Lines read from tables replace the response's lines of the same document."""
    from_tables = table_lines.select("stem").distinct()
    rest = response_lines_.join(from_tables, "stem", "left_anti")
    return table_lines.withColumn("line_source", F.lit("table")).unionByName(rest.withColumn("line_source", F.lit("response")))


def usable_patterns(spark, fields: tuple[CustomField, ...]) -> list[CustomField]:
    """Fields whose pattern compiles and has a capture group; others are skipped."""
    good = []
    for f in fields:
        if not f.regex:
            continue
        try:
            groups = spark.sparkContext._jvm.java.util.regex.Pattern.compile(f.regex).matcher("").groupCount()
        except Exception:  # noqa: BLE001 - an invalid operator pattern only disables its field
            continue
        if groups >= 1:
            good.append(f)
    return good


def regex_fields(documents: DataFrame, text: str, fields: tuple[CustomField, ...]) -> DataFrame:
    """One column per field with a usable pattern: group 1 of the first case-insensitive match."""
    usable = usable_patterns(documents.sparkSession, fields)
    return documents.select(
        *[c for c in documents.columns if c != text],
        *[blank_to_null(F.regexp_extract(text, f"(?i){f.regex}", 1)).alias(f.name) for f in usable],
    )


def table_fields(rows: DataFrame, tables: DataFrame, fields: tuple[CustomField, ...]) -> DataFrame:
    """(stem, name, value): first non-empty value under the first synonym a table's header carries."""
    keyed = [f for f in fields if f.table_keys]
    lowered = F.transform("headers", lambda h: strip(F.lower(h)))

    def position(f: CustomField) -> Column:
        spots = F.array(*[F.array_position("__low", k.lower()) for k in f.table_keys])
        return F.get(F.filter(spots, lambda p: p > 0), F.lit(0))

    located = tables.withColumn("__low", lowered).select(
        "stem", "table_idx",
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("name"), position(f).alias("col")) for f in keyed])).alias("s"),
    ).filter("s.col is not null")
    value = strip(F.get("cells", (F.col("s.col") - 1).cast("int")))
    return (
        rows.filter("row_idx > 0").join(located, ["stem", "table_idx"])
        .withColumn("value", value).filter("value is not null and value not in ('', 'None')")
        .groupBy("stem", F.col("s.name").alias("name"))
        .agg(F.min_by("value", F.struct("table_idx", "row_idx")).alias("value"))
    )


def merge_custom(by_regex: DataFrame, by_table: DataFrame, by_response: DataFrame) -> DataFrame:
    """(stem, name, value, origin) of three such long tables; regex beats table beats response."""
    ranked = None
    for rank, (origin, part) in enumerate((("regex", by_regex), ("table", by_table), ("response", by_response))):
        rows = part.select("stem", "name", F.struct(F.lit(rank).alias("rank"), F.lit(origin).alias("origin"), F.col("value").alias("value")).alias("x"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy("stem", "name").agg(F.min("x").alias("x")).select(
        "stem", "name", F.col("x.value").alias("value"), F.col("x.origin").alias("origin")
    )


def custom_maps(merged: DataFrame) -> DataFrame:
    """One map per document; its size is the number of configured fields."""
    return merged.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("custom_fields"))


def second_pass_requests(flagged: DataFrame) -> DataFrame:
    """Correction hints for invoices whose supplier is one of the operator's own companies."""
    number = F.coalesce(truthy(F.col("supplier.abn")), F.col("supplier.acn"))
    name = F.coalesce("supplier.name", F.lit("None"))
    hint = F.concat(
        F.lit("The previous answer named '"), name, F.lit("' (ABN: "), number,
        F.lit(") as the supplier. That company is the buyer. Find the party that issued this invoice."),
    )
    return flagged.filter("is_internal").select("stem", digits_only(number).alias("abn_key"), hint.alias("correction_hint"))


def prompts(documents: DataFrame, buyers: list[tuple[str, str]], fields: tuple[CustomField, ...]) -> DataFrame:
    """``documents(stem, markdown, has_lines, correction_hint)`` to ``(stem, prompt)``.

    Documents whose lines came from tables get the header-only task. ``buyers`` are the operator's
    own (name, number) pairs, part of the run's configuration.
    """
    hints = [f"- {f.name}: {f.hint}" for f in fields if f.source == "llm" and f.hint]
    custom = "\nAlso fill \"custom_fields\":\n" + "\n".join(hints) + "\nUse null where absent.\n" if hints else ""
    anchor = "".join(f"- BUYER NAME: {name} (ABN: {abn})\n" for name, abn in buyers)
    anchor = "\nThese companies are the buyer, never the supplier:\n" + anchor if anchor else ""
    task = F.when(
        F.col("has_lines"), F.lit("Extract the header fields of this invoice as JSON; set \"line_items\" to [].")
    ).otherwise(F.lit("Extract the header fields and all line items of this invoice as JSON."))
    correction = F.when(
        F.col("correction_hint").isNotNull(), F.concat(F.lit("\nCORRECTION: "), F.col("correction_hint"))
    ).otherwise(F.lit(""))
    return documents.select(
        "stem", F.concat(task, F.lit(anchor), F.lit(custom), correction, F.lit("\nInvoice:\n"), F.coalesce("markdown", F.lit(""))).alias("prompt")
    )
