"""Engine-shaped input tables, derived by Spark from the given tables and written once per session."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.fixture_sql import BASE, CTE, closure
from ledgerloom.params import MONEY, CustomField, Params
from ledgerloom.plans.reconcile import Masters
from ledgerloom.session import materialise
from ledgerloom.sources import masters as src

AS_OF = dt.date(1998, 6, 30)

PARAMS = Params(
    as_of=AS_OF,
    custom_fields=(
        CustomField("bsb", "BSB", regex=r"(\d{3}[-\s]\d{3})", table_keys=("bsb", "bsb no"), hint="Bank BSB number"),
        CustomField("contact", "Contact", regex=r"([a-z0-9.]+@[a-z0-9.]+)", hint="Contact e-mail"),
        CustomField("batch", "Batch", table_keys=("job ref", "batch no")),
        CustomField("project", "Project", source="lookup"),
    ),
)

_cache: dict[tuple[str, str, str], DataFrame] = {}


#: Views that most others are built on: written once, not computed again in each of them.
SHARED = ("pol", "poh")
#: Row by row projections of those: read off them, not written again.
PROJECTED = ("il", "lin")


def sql_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark plan over the given parquet tables and the shared views."""
    shared = tuple(n for n in SHARED if n != name)
    names = closure([name], shared)
    tables = sorted({t for n in names if n not in shared for t in BASE.get(n, [])})
    ctes = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    for n in names:
        if n in shared:
            stored = view(spark, sf_dir, n)
            alias = f"stored_{n}_{uuid.uuid4().hex}"
            stored.createOrReplaceTempView(alias)
            spark, text = stored.sparkSession, f"select * from {alias}"
        else:
            text = CTE[n]
        ctes.append(f"{n} as ({text})")
    return spark.sql("with " + ",\n".join(ctes) + f" select * from {name}")


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        _cache[key] = materialise(build(), f"input-{name}")
    return _cache[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in PROJECTED:
        return sql_view(spark, sf_dir, name)
    return _once(spark, sf_dir, name, lambda: sql_view(spark, sf_dir, name))


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(c) -> F.Column:
    return (F.col(c).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows as they stand in a supplier file."""
    return view(spark, sf_dir, "sup").select(
        F.col("supplier_ord").alias("ord"), F.concat(F.lit(" "), "supplier_id").alias("id"),
        F.concat("name", F.lit(" ")).alias("name"),
        F.concat(F.substring("abn", 1, 2), F.lit(" "), F.substring("abn", 3, 9)).alias("abn"),
        F.lit("").alias("acn"), "email", F.lit(" ").alias("phone"), F.lit(None).cast("string").alias("address"),
        F.concat("aliases", F.lit("| ")).alias("aliases"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "suppliers", lambda: src.supplier_master(supplier_rows(spark, sf_dir)))


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        poh, sup = view(spark, sf_dir, "poh"), view(spark, sf_dir, "sup")
        named = poh.join(sup.select(F.col("supplier_ord").alias("s_suppkey"), "name"), "s_suppkey", "left")
        tax = F.floor(F.col("subtotal_cents") / F.lit(10) + 0.5).cast("bigint")
        return named.withColumn("tax_c", tax).withColumn("total_c", F.col("subtotal_cents") + tax).select(
            F.upper("po_number").alias("po_key"), "po_number",
            F.col("po_supplier_id").alias("supplier_id"), F.col("name").alias("supplier_name"),
            cents("subtotal_cents").alias("subtotal"), cents("tax_c").alias("tax_amount"), cents("total_c").alias("total"),
            F.lit("AUD").alias("currency"),
        )

    return _once(spark, sf_dir, "purchase_orders", build)


def po_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, read off the stored view column by column."""
    rows = view(spark, sf_dir, "pol").select(
        F.upper("po_number").alias("po_key"), (F.col("line_number") - 1).cast("bigint").alias("po_pos"),
        F.col("line_number").cast("int").alias("line_number"), "sku", "description",
        F.col("qty").cast(MONEY).alias("quantity"), F.lit("ea").alias("unit"), cents("unit_cents").alias("unit_price"),
        (F.col("qty") * F.col("unit_cents")).alias("total_c"),
    )
    return rows.withColumn("total", cents("total_c")).drop("total_c").withColumn(
        "expected_quantity", F.col("quantity")
    ).withColumn("expected_unit_price", F.col("unit_price"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per header of the stored view."""
    none = F.lit(None).cast("string")
    h = view(spark, sf_dir, "hdr")
    supplier = F.struct(
        F.col("inv_name").alias("name"), F.col("inv_abn").alias("abn"), F.col("inv_acn").alias("acn"),
        F.when(F.col("ok") % 2 == 0, F.lit("1 Main St")).alias("address"), F.col("inv_email").alias("email"),
        none.alias("phone"), none.alias("website"),
    )
    return h.select(
        "ok", "stem", "invoice_number", "invoice_date", "due_date",
        F.when(F.col("variant") != 7, supplier).alias("supplier"),
        F.col("po_ref").alias("po_number"), cents("subtotal_cents").alias("subtotal"),
        F.lit(0.1).alias("tax_rate"), cents("tax_cents").alias("tax_amount"),
        F.lit(None).cast(MONEY).alias("shipping"), F.lit(None).cast(MONEY).alias("other_charges"),
        cents("total_cents").alias("total"), F.lit("AUD").alias("currency"),
        F.when(F.col("ok") % 3 == 0, F.create_map(F.lit("bsb"), F.concat(F.lit("123-"), F.lpad((F.col("ok") % 1000).cast("string"), 3, "0"))))
        .otherwise(F.create_map().cast("map<string,string>")).alias("custom_fields"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines as extracted: some totals missing. Read off the stored view column by column."""
    return view(spark, sf_dir, "lin").select(
        "ok", "stem", "line_index", (F.col("line_index") + 1).cast("int").alias("line_number"), "sku", "description",
        F.lit("ea").alias("unit"), F.col("qty").cast(MONEY).alias("quantity"), cents("unit_cents").alias("unit_price"),
        F.lit(None).cast("decimal(9,6)").alias("discount"), cents("raw_cents").alias("total"), F.lit(False).alias("total_computed"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.invoices import fill_computed_totals

    return fill_computed_totals(raw_lines(spark, sf_dir))


def internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's own company: the number used by every twelfth invoice."""
    hdr = view(spark, sf_dir, "hdr")
    return hdr.filter("variant = 9").select(
        F.lit("COMPANY1").alias("id"), F.col("inv_name").alias("name"), F.col("inv_abn").alias("abn")
    ).distinct()


def masters(spark: SparkSession, sf_dir: str) -> Masters:
    return Masters(
        suppliers(spark, sf_dir), purchase_orders(spark, sf_dir), po_lines(spark, sf_dir), internal(spark, sf_dir)
    )
