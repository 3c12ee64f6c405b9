"""Registered file queries: reference files written from the given tables, with other columns than the reader knows, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.fixture_sql import with_views
from ledgerloom.session import shared_dir
from ledgerloom.sources import masters as M

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str):
    def register(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return register


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def write(df, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


@query("supplier_file", with_views("sup") + """
 select supplier_id, name, abn, cast(null as varchar) as acn, email, cast(null as varchar) as phone,
  case when supplier_ord%3=0 then 'Level ' || supplier_ord || chr(10) || '"North" St' end as address, aliases
 from sup""")
def supplier_file(spark, sf):
    """Two kinds of files in one folder: re-ordered columns with one too many and quoted line breaks, and files without most columns."""
    path, rows = folder(spark), I.view(spark, sf, "sup")
    address = F.concat(F.lit("Level "), F.col("supplier_ord").cast("string"), F.lit('\n"North" St'))
    third = F.col("supplier_ord") % 3 == 0
    write(rows.filter(third).select(F.lit("x").alias("colour"), address.alias("address"), "aliases", "email", "abn", "name", F.col("supplier_id").alias("id")), path)
    write(rows.filter(~third).select(F.col("supplier_id").alias("id"), "name", "aliases", "abn", "email"), path, "append")
    out = M.supplier_master(M.read_csv(spark, f"{path}/*.csv", M.SUPPLIER_COLUMNS))
    return out.drop("supplier_ord").withColumn("aliases", F.array_join("aliases", "|"))


@query("po_file", with_views("pol") + """
 select upper(po_number) as po_key, line_number, sku, description, qty as quantity, unit_cents,
  case when ok%2=0 then 'ea' end as unit from pol""")
def po_file(spark, sf):
    """Order lines with and without a unit column, the columns in another order."""
    path, rows = folder(spark), I.view(spark, sf, "pol")
    price = (F.col("unit_cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("unit_price")
    write(rows.filter("ok % 2 = 0").select("description", price, "po_number", "sku", F.lit("ea").alias("unit"), "line_number", F.col("qty").alias("quantity")), path)
    write(rows.filter("ok % 2 <> 0").select("po_number", "line_number", "sku", F.lit("late").alias("note"), "description", F.col("qty").alias("quantity"), price), path, "append")
    lines = M.order_lines(M.read_csv(spark, f"{path}/*.csv", M.ORDER_LINE_COLUMNS), rows.select(F.upper("po_number").alias("po_key")).distinct())
    return lines.select(
        "po_key", F.col("line_number").cast("bigint").alias("line_number"), "sku", "description", F.col("quantity").cast("bigint").alias("quantity"),
        F.floor(F.col("unit_price") * 100).cast("bigint").alias("unit_cents"), "unit",
    )


@query("internal_companies", """
 select 'C' || c_custkey as id, c_name as name, cast(10000000000 + c_custkey as varchar) as abn, cast(null as varchar) as email,
  case when c_custkey%2=0 then lower(c_name) else '' end as aliases from customer""")
def internal_companies(spark, sf):
    """JSON records with a missing and an unknown field; every file is one array of up to 500 companies, as the format wants it."""
    path, rows = folder(spark), I.base(spark, sf, "customer")
    key = F.col("c_custkey")
    aliases = F.when(key % 2 == 0, F.array(F.lower("c_name")))
    out = rows.select(F.floor(key / 500).alias("file"), F.struct(
        F.lit(7).alias("rank"), aliases.alias("aliases"), F.concat(F.lit("C"), key.cast("string")).alias("id"), F.col("c_name").alias("name"),
        (key + F.lit(10_000_000_000)).cast("string").alias("abn")).alias("company"))
    arrays = out.groupBy("file").agg(F.to_json(F.collect_list("company")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return M.internal_companies(spark, f"{path}/*.txt").select("id", "name", "abn", "email", F.array_join("aliases", "|").alias("aliases"))


@query("lookup_table", "select cast(p_partkey as varchar) as code, p_name as label from part")
def lookup_table(spark, sf):
    """A lookup list of free columns, written and read back."""
    path = folder(spark)
    rows = I.base(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"))
    M.write_lookup(rows, f"{path}/parts.csv")
    return M.lookup_table(spark, path, "parts.csv").select("code", "label")
