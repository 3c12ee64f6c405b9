"""Master-data maintenance: codes for new suppliers and duplicate warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import strip
from ledgerloom.operators.ordinals import numbered


def new_suppliers(requests: DataFrame, master: DataFrame, prefix: str) -> DataFrame:
    """Rows to append: prefix + next number in ``ord`` order, trimmed fields, no aliases."""
    suffix = F.when(F.startswith("id", F.lit(prefix)), F.substr("id", F.lit(len(prefix) + 1)).try_cast("bigint"))
    # One aggregated value, read as a scalar subquery.
    top = master.agg(F.coalesce(F.max(suffix), F.lit(0)).alias("top")).scalar()
    ordered = numbered(requests.withColumn("__one", F.lit(1)), ["__one"], "ord", "n")
    fields = [strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "abn", "acn", "email", "phone", "address")]
    return ordered.select(
        F.concat(F.lit(prefix), (top + F.col("n")).cast("string")).alias("id"), *fields, F.lit("").alias("aliases")
    )


def duplicate_warnings(requests: DataFrame, master: DataFrame) -> DataFrame:
    """First master row (file order) with the same number or name, number first: two equi-joins."""
    def abn(c: str):
        return F.nullif(strip(F.replace(c, F.lit(" "), F.lit(""))), F.lit(""))

    row = F.struct(F.col("ord").alias("m_ord"), "id", F.col("name").alias("m_name"))
    known = master.select(row.alias("m"), abn("abn").alias("abn_key"), F.lower(strip(F.col("name"))).alias("name_key"))
    asked = requests.select("ord", abn("abn").alias("abn_key"), F.lower(strip(F.col("name"))).alias("name_key"))

    def first_of(key: str, rule: int) -> DataFrame:
        """At most one master row a request, however many share the key."""
        index = known.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("m").alias("m"))
        return asked.join(index, key).select("ord", "m.m_ord", F.lit(rule).alias("rule"), "m.id", "m.m_name")

    both = first_of("abn_key", 0).unionByName(first_of("name_key", 1))
    first = both.groupBy("ord").agg(F.min(F.struct("m_ord", "rule", "id", "m_name")).alias("d"))
    text = F.when(
        F.col("d.rule") == 0, F.concat(F.lit("A supplier with this ABN already exists: "), F.col("d.m_name"), F.lit(" ("), F.col("d.id"), F.lit(")"))
    ).otherwise(F.concat(F.lit("A supplier with this name already exists ("), F.col("d.id"), F.lit(")")))
    return first.select("ord", F.col("d.id").alias("id"), text.alias("warning"))
