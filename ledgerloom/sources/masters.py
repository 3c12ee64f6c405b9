"""Reference tables: suppliers, purchase orders, internal companies, lookup lists."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import alias_list, blank_to_null, digits_only, strip, to_money
from ledgerloom.operators.ordinals import numbered
from ledgerloom.params import MONEY

# Column names of the reference files.
SUPPLIER_COLUMNS = ("id", "name", "abn", "acn", "email", "phone", "address", "aliases")
ORDER_COLUMNS = (
    "po_number", "supplier_id", "supplier_name", "issue_date", "expected_delivery", "subtotal",
    "tax_amount", "total", "currency", "status", "notes",
)
ORDER_LINE_COLUMNS = ("po_number", "line_number", "sku", "description", "quantity", "unit", "unit_price", "total")

COMPANY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "abn", "acn", "email", "phone", "address")]
    + [T.StructField("aliases", T.ArrayType(T.StringType()))]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence of a file or glob in any Hadoop-supported file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def text_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_files(spark: SparkSession, path: str) -> list[tuple[str, list[str], bool]]:
    """(file, column names, whether a quoted cell holds a line break) of every non-empty CSV file under ``path``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"), F.max(odd).alias("open")).collect()
    files = []
    for r in sorted(found, key=lambda r: r["file"]):
        names = next(csv.reader([r["head"].removeprefix("\ufeff")]), [])
        if names:
            files.append((r["file"], names, bool(r["open"])))
    return files


def read_named(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """Rows of all files under ``path`` as text columns found by name, in (file name, line) order by ``ord``; and the names.

    Files may differ in their columns: they are read by groups of equal headers, and a column that a file lacks is null. Files without quoted
    line breaks are split between tasks. ``ord`` numbers the rows from 0: each block's offset is the number of rows in the blocks
    before it, a table as long as there are blocks.
    """
    groups: dict[tuple, list[str]] = {}
    names: dict[str, None] = {}
    for file, header, breaks in csv_files(spark, path):
        groups.setdefault((tuple(header), breaks), []).append(file)
        names |= dict.fromkeys(header)
    parts = []
    for (header, breaks), files in groups.items():
        columns = text_schema(tuple(f"c{i}" for i in range(len(header))))
        rows = spark.read.csv(files, header=True, schema=columns, quote='"', escape='"', multiLine=breaks, enforceSchema=True)
        # of a name that is there twice the last cell counts
        by_name = {name: F.col(f"c{i}") for i, name in enumerate(header)}
        parts.append(rows.select(
            *[(by_name[n] if n in by_name else F.lit(None).cast("string")).alias(n) for n in names],
            F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at"),
        ))
    if not parts:
        return None, []
    rows = reduce(DataFrame.unionByName, parts)
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    offsets = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ord_ = (F.col("__at") - F.col("__first") + F.col("__before")).alias("ord")
    return rows.join(offsets, ["__file", "__block"]).select(*[F.col(f"`{n}`") for n in names], ord_), list(names)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All-text rows by column name with their position ``ord``; missing columns are null, others are ignored; an absent file gives no rows."""
    found, names = read_named(spark, path) if path_exists(spark, path) else (None, [])
    if found is None:
        return spark.createDataFrame([], text_schema(columns).add("ord", T.LongType()))
    return found.select(*[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in columns], "ord")


def lookup_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A lookup list by bare file name; names that leave the folder give no rows."""
    if not re.fullmatch(r"[\w\-. ]+", name) or ".." in name or not path_exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], T.StructType())
    found, _ = read_named(spark, f"{folder}/{name}")
    return spark.createDataFrame([], T.StructType()) if found is None else found.drop("ord")


def write_lookup(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Overwrite or append a reference table as CSV."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def supplier_master(rows: DataFrame) -> DataFrame:
    """Typed suppliers out of raw text rows with ``ord``."""
    return rows.select(
        F.col("ord").alias("supplier_ord"),
        strip(F.col("id")).alias("supplier_id"),
        strip(F.col("name")).alias("name"),
        digits_only(F.col("abn")).alias("abn"),
        digits_only(F.col("acn")).alias("acn"),
        blank_to_null(F.col("email")).alias("email"),
        blank_to_null(F.col("phone")).alias("phone"),
        blank_to_null(F.col("address")).alias("address"),
        alias_list(F.col("aliases")).alias("aliases"),
    )


def _po_key(c: Column) -> Column:
    return F.upper(strip(c))


def order_headers(rows: DataFrame) -> DataFrame:
    """Typed order headers; the last row of a number wins (a partial-aggregable maximum)."""
    typed = rows.select(
        _po_key(F.col("po_number")).alias("po_key"),
        "ord",
        F.struct(
            strip(F.col("po_number")).alias("po_number"),
            *[blank_to_null(F.col(c)).alias(c) for c in ("supplier_id", "supplier_name", "issue_date", "expected_delivery")],
            *[to_money(F.col(c)).alias(c) for c in ("subtotal", "tax_amount", "total")],
            strip(F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("AUD"))).alias("currency"),
            blank_to_null(F.col("status")).alias("status"),
            blank_to_null(F.col("notes")).alias("notes"),
        ).alias("h"),
    )
    return typed.groupBy("po_key").agg(F.max_by("h", "ord").alias("h")).select("po_key", "h.*")


def _typed_lines(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    return rows.select(
        _po_key(F.col("po_number")).alias("po_key"),
        "ord",
        F.nullif(strip(F.col("line_number")).try_cast("int"), F.lit(0)).alias("line_number"),
        blank_to_null(F.col("sku")).alias("sku"),
        F.coalesce(strip(F.col("description")), F.lit("")).alias("description"),
        F.coalesce(to_money(F.col("quantity")), zero).alias("quantity"),
        blank_to_null(F.col("unit")).alias("unit"),
        F.coalesce(to_money(F.col("unit_price")), zero).alias("unit_price"),
        F.coalesce(to_money(F.col("total")), zero).alias("total"),
    )


def order_lines(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of known orders with their 0-based position and the values found under their number.

    A finding quotes the first order line carrying the reported number, which is not always the
    line itself when numbers repeat or are absent.
    """
    known = _typed_lines(rows).join(headers.select("po_key"), "po_key", "left_semi")
    placed = numbered(known, ["po_key"], "ord", "n").withColumn("po_pos", F.col("n") - 1).drop("n", "ord")
    first_of_number = (
        placed.filter("line_number is not null")
        .groupBy("po_key", F.col("line_number").cast("bigint").alias("__number"))
        .agg(F.min_by(F.struct("quantity", "unit_price"), "po_pos").alias("__first"))
    )
    reported = F.coalesce(F.col("line_number").cast("bigint"), F.col("po_pos") + 1)
    return (
        placed.withColumn("__number", reported)
        .join(first_of_number, ["po_key", "__number"], "left")
        .withColumn("expected_quantity", F.col("__first.quantity"))
        .withColumn("expected_unit_price", F.col("__first.unit_price"))
        .drop("__number", "__first")
    )


def orphan_lines(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Order lines whose order is unknown; reported, never attached."""
    return _typed_lines(rows).join(headers.select("po_key"), "po_key", "left_anti")


def internal_companies(spark: SparkSession, path: str) -> DataFrame:
    """The operator's own companies from a JSON array; an absent file gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], COMPANY_SCHEMA)
    rows = spark.read.schema(COMPANY_SCHEMA).json(path, multiLine=True)
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
