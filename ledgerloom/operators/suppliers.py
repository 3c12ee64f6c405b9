"""Supplier resolution: registration number, exact name, similar name, e-mail domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import (
    digits_only, email_domain, name_key, registration_key, spread_nulls, truthy,
)
from ledgerloom.functions.similarity import token_sort
from ledgerloom.operators.matchcache import cached_best
from ledgerloom.operators.simjoin import similar_pairs
from ledgerloom.params import Params
from ledgerloom.session import materialise

BLOCK = ["name", "abn", "acn", "email"]


def supplier_names(suppliers: DataFrame) -> DataFrame:
    """Every name a supplier answers to: canonical first, then aliases in order."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return suppliers.select(
        "supplier_ord", "supplier_id", F.posexplode(names).alias("name_ord", "any_name")
    ).select("supplier_ord", "supplier_id", "name_ord", "any_name", F.lower("any_name").alias("name_key"))


def _first_wins(rows: DataFrame, key: str) -> DataFrame:
    """Lowest file position per key, as a partial-aggregable minimum."""
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("supplier_ord").alias("supplier_ord"))
    )


def abn_index(suppliers: DataFrame) -> DataFrame:
    return _first_wins(suppliers.select("supplier_ord", digits_only(F.col("abn")).alias("abn_key")), "abn_key")


def name_index(suppliers: DataFrame) -> DataFrame:
    return _first_wins(supplier_names(suppliers).select("supplier_ord", "name_key"), "name_key")


def domain_index(suppliers: DataFrame) -> DataFrame:
    rows = suppliers.select("supplier_ord", truthy(email_domain(F.col("email"))).alias("domain_key"))
    return _first_wins(rows, "domain_key")


def supplier_blocks(invoices: DataFrame) -> DataFrame:
    """Distinct supplier blocks. Invoices repeat their suppliers, so matching works on far fewer rows."""
    return (
        invoices.filter(F.col("supplier").isNotNull())
        .select(*[F.col(f"supplier.{c}").alias(c) for c in BLOCK])
        .distinct()
        .withColumn("abn_key", registration_key(F.col("abn"), F.col("acn")))
        .withColumn("name_key", name_key(F.col("name")))
        .withColumn("domain_key", truthy(email_domain(F.col("email"))))
    )


def fuzzy_best(keys: DataFrame, suppliers: DataFrame, threshold: int) -> DataFrame:
    """Best similar master name per ``name_key``: highest score, then file order, then name order."""
    probes = keys.select(token_sort(F.col("name_key")).alias("probe"), "name_key").filter("probe <> ''")
    names = supplier_names(suppliers).select(
        "supplier_ord", "name_ord", token_sort(F.col("name_key")).alias("candidate")
    ).filter("candidate <> ''")
    # Equal texts score 100 and no others do, so their names are decided by an equi-join and stay out of the similarity join.
    texts, candidates = probes.select("probe").distinct(), names.select("candidate").distinct()
    equal = texts.join(candidates, F.col("probe") == F.col("candidate")).select("probe", "candidate", F.lit(100.0).alias("score"))
    others = texts.join(candidates.select(F.col("candidate").alias("probe")), "probe", "left_anti")
    near = similar_pairs(others, candidates, "probe", "candidate", threshold, best_only=True)
    pairs = near.select("probe", "candidate", "score").unionByName(equal)
    first_owner = names.groupBy("candidate").agg(F.min(F.struct("supplier_ord", "name_ord")).alias("owner"))
    best = (
        pairs.join(first_owner, "candidate")
        .groupBy("probe")
        .agg(
            F.max(
                F.struct(
                    "score", (-F.col("owner.supplier_ord")).alias("neg_ord"), (-F.col("owner.name_ord")).alias("neg_name")
                )
            ).alias("b")
        )
        .select("probe", (-F.col("b.neg_ord")).alias("supplier_ord"), F.col("b.score").alias("score"))
    )
    return probes.join(best, "probe").select("name_key", "supplier_ord", "score")


def match_struct(method: Column, ord_: Column, confidence: Column, field: Column, value: Column, fuzzy: Column) -> Column:
    return F.struct(
        method.alias("match_method"), ord_.alias("supplier_ord"), confidence.cast("double").alias("confidence"),
        F.struct(field.alias("field"), value.alias("value"), fuzzy.cast("double").alias("fuzzy_score")).alias("matched_on"),
    )


def resolve_blocks(blocks: DataFrame, suppliers: DataFrame, params: Params) -> DataFrame:
    """Cascade over distinct blocks: number > exact name > similar name > e-mail domain.

    Dimension sides carry no broadcast hint: Spark broadcasts them while their measured size is
    below its threshold and shuffles beyond it.
    """
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    step = (
        blocks.join(abn_index(suppliers).withColumnRenamed("supplier_ord", "abn_ord"), "abn_key", "left")
        .join(name_index(suppliers).withColumnRenamed("supplier_ord", "name_ord"), "name_key", "left")
        .join(domain_index(suppliers).withColumnRenamed("supplier_ord", "domain_ord"), "domain_key", "left")
    )
    # Read twice, for the open names and for the result: written once (distinct supplier blocks only).
    step = materialise(step, "supplier-blocks")
    # Only names no cheaper strategy resolved enter the similarity join.
    open_names = (
        step.filter("abn_ord is null and name_ord is null and name_key is not null").select("name_key").distinct()
    )
    threshold = params.supplier_fuzzy_threshold
    scored = lambda keys: fuzzy_best(keys, suppliers, threshold)
    if params.match_cache:
        similar = cached_best(open_names, supplier_names(suppliers), threshold, params.match_cache, scored)
    else:
        similar = scored(open_names)
    fuzzy = similar.select(
        "name_key", F.col("supplier_ord").alias("fuzzy_ord"), "score"
    )
    step = step.join(fuzzy, "name_key", "left")
    confidence = F.col("score") / 100
    chosen = F.coalesce(
        F.when(
            F.col("abn_ord").isNotNull(),
            match_struct(F.lit("abn_exact"), F.col("abn_ord"), F.lit(1.0), F.lit("abn"),
                         F.coalesce(truthy(F.col("abn")), F.col("acn")), none_d),
        ),
        F.when(
            F.col("name_ord").isNotNull(),
            match_struct(F.lit("name_exact"), F.col("name_ord"), F.lit(0.95), F.lit("name"), F.col("name"), none_d),
        ),
        F.when(
            F.col("fuzzy_ord").isNotNull(),
            match_struct(F.lit("name_fuzzy"), F.col("fuzzy_ord"), confidence, F.lit("name"), F.col("name_key"), confidence),
        ),
        F.when(
            F.col("domain_ord").isNotNull(),
            match_struct(F.lit("email_domain"), F.col("domain_ord"), F.lit(0.7), F.lit("email_domain"),
                         F.col("domain_key"), none_d),
        ),
    )
    master = suppliers.select("supplier_ord", "supplier_id", F.col("name").alias("supplier_name"), digits_only(F.col("abn")).alias("master_abn"))
    return (
        step.select(*BLOCK, chosen.alias("m"))
        .filter("m is not null")
        .withColumn("supplier_ord", F.col("m.supplier_ord"))
        .join(master, "supplier_ord")
        .select(
            *BLOCK,
            F.struct(
                "supplier_id", "supplier_name", F.col("m.match_method").alias("match_method"),
                F.col("m.confidence").alias("confidence"), F.col("master_abn").alias("abn"),
                F.col("m.matched_on").alias("matched_on"),
            ).alias("matched_supplier"),
        )
    )


def _join_block(invoices: DataFrame, resolved: DataFrame, how: str = "left") -> DataFrame:
    r = resolved
    cond = None
    for c in BLOCK:
        r = r.withColumnRenamed(c, f"__{c}")
        eq = F.col(f"supplier.{c}").eqNullSafe(F.col(f"__{c}"))
        cond = eq if cond is None else cond & eq
    cond = cond & F.col("supplier").isNotNull()
    return invoices.join(r, cond, how).drop(*[f"__{c}" for c in BLOCK])


def match_suppliers(invoices: DataFrame, suppliers: DataFrame, params: Params) -> DataFrame:
    """Adds ``matched_supplier`` (null without a supplier block or a match)."""
    return _join_block(invoices, resolve_blocks(supplier_blocks(invoices), suppliers, params))


def flag_internal(invoices: DataFrame, internal: DataFrame) -> DataFrame:
    """Adds ``is_internal``: the supplier's number belongs to one of the operator's own companies."""
    own = (
        internal.select(digits_only(F.col("abn")).alias("__own")).filter("__own is not null").distinct()
        .withColumn("__hit", F.lit(True))
    )
    key = registration_key(F.col("supplier.abn"), F.col("supplier.acn"))
    return (
        invoices.withColumn("__key", spread_nulls(key, F.col("stem")))
        .join(own, F.col("__key") == F.col("__own"), "left")
        .withColumn("is_internal", F.coalesce("__hit", F.lit(False)))
        .drop("__key", "__own", "__hit")
    )
