"""Purchase-order lookup and one-to-one line assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import blank_to_null, order_key, spread_nulls, truthy, within, within_pct
from ledgerloom.functions.similarity import lcs_length, may_reach, reaches, score, token_sort
from ledgerloom.operators.assignment import BOTH, LEFT, MATCH, ORDER_LINE, PAIR, assign, containing, similar
from ledgerloom.operators.simjoin import similar_pairs
from ledgerloom.operators.textsearch import contained
from ledgerloom.params import Params
from ledgerloom.session import materialise


def lookup_orders(invoices: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """Adds ``po_key`` (of the found order), ``po_found`` and ``matched_po``.

    No number gives null; a number without a record gives a stub that carries only the number.
    """
    po = purchase_orders.select(
        F.col("po_key").alias("__key"),
        F.struct(
            "po_number", F.col("total").alias("po_total"), F.col("supplier_name").alias("po_supplier_name"),
            F.col("supplier_id").alias("po_supplier_id"),
        ).alias("__po"),
    )
    wanted = blank_to_null(F.col("po_number"))
    # invoices without a number must not meet in one task
    joined = invoices.join(po, spread_nulls(order_key(F.col("po_number")), F.col("stem")) == F.col("__key"), "left")
    return (
        joined.withColumn("po_found", F.col("__po").isNotNull())
        .withColumn("po_key", F.col("__key"))
        .withColumn(
            "matched_po",
            F.when(
                wanted.isNotNull(),
                F.struct(
                    F.coalesce("__po.po_number", wanted).alias("po_number"),
                    F.lit("invoice_reference").alias("match_method"),
                    F.col("__po.po_total").alias("po_total"),
                    F.col("__po.po_supplier_name").alias("po_supplier_name"),
                    F.col("__po.po_supplier_id").alias("po_supplier_id"),
                ),
            ),
        )
        .drop("__key", "__po")
    )


def linked(invoices: DataFrame) -> DataFrame:
    """(stem, po_key) of invoices whose order exists."""
    return invoices.filter("po_found").select("stem", "po_key")


def pair_lines(links: DataFrame, lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Invoice line x order line inside a document: every pair, for looking at scores. The assignment works on distinct texts instead."""
    offered = links.join(
        po_lines.select(
            "po_key", "po_pos", F.col("line_number").alias("po_line_number_raw"),
            F.col("sku").alias("po_sku"), F.col("description").alias("po_description"),
            F.col("quantity").alias("po_quantity"), F.col("unit_price").alias("po_unit_price"),
            F.col("total").alias("po_total"), "expected_quantity", "expected_unit_price",
            token_sort(F.col("description")).alias("po_sorted"),
        ),
        "po_key",
    )
    mine = lines.select(
        "stem", "line_index", "sku", "description", "quantity", "unit_price", "total",
        token_sort(F.col("description")).alias("sorted"),
    )
    return mine.join(offered, "stem")


def sku_equal(sku: Column, po_sku: Column) -> Column:
    return F.coalesce(F.upper(truthy(sku)) == F.upper(truthy(po_sku)), F.lit(False))


def score_pairs(pairs: DataFrame, threshold: int) -> DataFrame:
    """Keeps acceptable pairs: equal SKU (score 100), or description score >= ``threshold``."""
    la, lb = F.length("sorted"), F.length("po_sorted")
    with_sku = pairs.withColumn("sku_equal", sku_equal(F.col("sku"), F.col("po_sku")))
    described = truthy(F.col("description")).isNotNull()
    need = ~F.col("sku_equal") & described & may_reach(la, lb, threshold)
    scored = with_sku.withColumn(
        "lcs", lcs_length(F.when(need, F.col("sorted")), F.when(need, F.col("po_sorted")))
    )
    keep = F.col("sku_equal") | reaches(F.col("lcs"), la, lb, threshold)
    return scored.filter(keep).withColumn(
        "score", F.when(F.col("sku_equal"), F.lit(100.0)).otherwise(score(F.col("lcs"), la, lb))
    )


def substring_pairs(pairs: DataFrame) -> DataFrame:
    """The opt-in fallback: equal SKU, or one lower-case description contains the other (score 80)."""
    d, p = F.lower(truthy(F.col("description"))), F.lower(F.coalesce("po_description", F.lit("")))
    with_sku = pairs.withColumn("sku_equal", sku_equal(F.col("sku"), F.col("po_sku")))
    hit = F.col("sku_equal") | F.coalesce(F.contains(p, d) | F.contains(d, p), F.lit(False))
    return with_sku.filter(hit).withColumn("score", F.when(F.col("sku_equal"), F.lit(100.0)).otherwise(F.lit(80.0)))


def _candidate(params: Params) -> Column:
    mine, theirs = (lambda k: F.col(f"mine.{k}")), (lambda k: F.col(f"theirs.{k}"))
    return F.struct(
        "line_index",
        "tier",
        (-F.col("score")).alias("neg_score"),
        "po_pos",
        _po_line_number().alias("po_line_number"),
        theirs("description").alias("po_description"),
        within(mine("quantity"), theirs("quantity"), params.quantity_tolerance).alias("quantity_matches"),
        within_pct(mine("unit_price"), theirs("unit_price"), params.price_tolerance_pct).alias("price_matches"),
        within(mine("total"), theirs("total"), params.total_tolerance).alias("total_matches"),
        theirs("expected_quantity").alias("expected_quantity"),
        theirs("expected_unit_price").alias("expected_unit_price"),
    )


def _po_line_number() -> Column:
    return F.coalesce(F.nullif(F.col("theirs.line_number").cast("bigint"), F.lit(0)), F.col("po_pos") + 1)


#: Documents with at most so many pairs of a line and an order line have their texts compared pair by pair; a search for one text in another
#: costs far less than a score.
FEW_PAIRS = {"similarity": 1 << 12, "substring": 1 << 16}


def large_documents(links: DataFrame, lines: DataFrame, po_lines: DataFrame, described: Column, po_described: Column, most: int) -> DataFrame:
    """The stems of documents with more than ``most`` pairs of a text and an order's text; only counts are shuffled."""
    mine = lines.groupBy("stem").agg(F.count(described).alias("n"))
    theirs = links.join(po_lines.groupBy("po_key").agg(F.count(po_described).alias("m")), "po_key").groupBy("stem").agg(F.sum("m").alias("m"))
    return mine.join(theirs, "stem").filter(F.col("n") * F.col("m") > most).select("stem")


def _containing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    inner = contained(mine.withColumnRenamed("text", "part"), theirs.withColumnRenamed("po_text", "whole"))
    outer = contained(theirs.withColumnRenamed("po_text", "part"), mine.withColumnRenamed("text", "whole"))
    both = inner.select("stem", F.col("part").alias("text"), F.col("whole").alias("po_text")).unionByName(
        outer.select("stem", F.col("whole").alias("text"), F.col("part").alias("po_text"))
    )
    return both.distinct().withColumn("score", F.lit(80.0))


def _similar(mine: DataFrame, theirs: DataFrame, threshold: int) -> DataFrame:
    """An empty text, which has no length band, is like the empty text alone."""
    theirs = theirs.select(F.col("stem").alias("__stem"), "po_text").withColumnRenamed("__stem", "stem")  # may be the same column as the other
    found = similar_pairs(mine.filter("text <> ''"), theirs.filter("po_text <> ''"), "text", "po_text", threshold, scope=["stem"])
    empty = mine.filter("text = ''").join(theirs.filter("po_text = ''"), "stem").withColumn("score", F.lit(100.0))
    return found.select("stem", "text", "po_text", "score").unionByName(empty.select("stem", "text", "po_text", "score"))


def match_lines(invoices: DataFrame, lines: DataFrame, po_lines: DataFrame, params: Params, method: str = "similarity") -> DataFrame:
    """All that the assignment finds, in one pass over the documents of linked orders: read by ``assigned``, ``line_matches``, ``unmatched_po_lines``.

    Texts of a document with few pairs are compared in the pass, by the lines that need it. Those of a large document never form all their pairs:
    a contained text finds the texts that hold its rarest gram, and similar texts are looked for in blocks by length, where their characters
    bound the score.
    """
    links = linked(invoices)
    threshold = params.line_fuzzy_threshold
    by_parts = method == "substring"

    def texts_of(mine: Column, theirs: Column) -> tuple[Column, Column]:
        described = truthy(mine)
        if by_parts:
            return F.lower(described), F.lower(F.coalesce(theirs, F.lit("")))
        return F.when(described.isNotNull(), token_sort(mine)), token_sort(theirs)

    def keys(rows: DataFrame) -> DataFrame:
        text, po_text = texts_of(F.col("mine.description"), F.col("theirs.description"))
        of_order = F.col("kind") == ORDER_LINE
        sku = F.upper(truthy(F.when(of_order, F.col("theirs.sku")).otherwise(F.col("mine.sku"))))
        return rows.withColumn("sku", sku).withColumn("text", F.when(of_order, po_text).otherwise(text))

    po_described = F.lit(1) if by_parts else F.col("description")
    large = materialise(large_documents(links, lines, po_lines, truthy(F.col("description")), po_described, FEW_PAIRS[method]), "large-documents")
    mine = lines.select("stem", "line_index", F.struct("sku", "description", "quantity", "unit_price", "total").alias("mine"))
    numbered = links.withColumn("link", F.monotonically_increasing_id())
    stock = numbered.join(po_lines, "po_key").select("stem", "po_pos", "link", F.struct(
        "line_number", "sku", "description", "quantity", "unit_price", "total", "expected_quantity", "expected_unit_price").alias("theirs"))
    rate, pairs, marked = containing if by_parts else similar(threshold), None, mine.withColumn("offered", F.lit(False))
    if not large.isEmpty():
        marked = mine.join(large.withColumn("__large", F.lit(True)), "stem", "left").withColumn("offered", F.coalesce("__large", F.lit(False))).drop("__large")
        text, po_text = texts_of(F.col("mine.description"), F.col("theirs.description"))
        ours = mine.join(large, "stem", "left_semi").select("stem", text.alias("text")).filter("text is not null").distinct()
        offers = stock.join(large, "stem", "left_semi").select("stem", po_text.alias("po_text")).filter("po_text is not null").distinct()
        pairs = _containing(ours, offers) if by_parts else _similar(ours, offers, threshold)
    found = assign(marked, stock, pairs, keys, rate)
    paired = F.col("role").isin(BOTH, PAIR, MATCH) & F.col("po_pos").isNotNull()
    return found.select(
        "stem", "role", "links", "line_index", "po_pos", F.when(F.col("role") == LEFT, _po_line_number()).alias("left_number"),
        *[F.when(F.col("role").isin(BOTH, MATCH), F.col(f"mine.{k}")).alias(k) for k in ("description", "quantity", "unit_price")],
        F.when(paired, _candidate(params)).alias("c"),
    )


def assigned(found: DataFrame) -> DataFrame:
    """One row per matched invoice line: (stem, candidate struct ``c``)."""
    return found.filter(F.col("role").isin(BOTH, PAIR) & F.col("c").isNotNull()).select("stem", "c")


def assign_lines(
    invoices: DataFrame, lines: DataFrame, po_lines: DataFrame, params: Params, method: str = "similarity"
) -> DataFrame:
    """One row per matched invoice line: (stem, candidate struct ``c``). One plan for documents of every size."""
    return assigned(match_lines(invoices, lines, po_lines, params, method))


def line_matches(found: DataFrame) -> DataFrame:
    """One row per invoice line of a found, non-empty order, matched or not; per link, if the document has several."""
    rows = found.filter(F.col("role").isin(BOTH, MATCH)).withColumn("__link", F.explode(F.sequence(F.lit(1), F.col("links"))))
    return rows.select(
        "stem", "line_index", F.col("description").alias("invoice_description"),
        "quantity", "unit_price",
        F.col("c.po_pos").alias("po_pos"), F.col("c.po_line_number").alias("po_line_number"),
        F.col("c.po_description").alias("po_description"),
        F.coalesce(F.round(-F.col("c.neg_score") / 100, 3), F.lit(0.0)).alias("match_score"),
        (-F.col("c.neg_score")).alias("raw_score"),
        F.col("c").isNotNull().alias("matched"),
        F.col("c.quantity_matches").alias("quantity_matches"),
        F.col("c.price_matches").alias("price_matches"),
        F.col("c.total_matches").alias("total_matches"),
        F.col("c.expected_quantity").alias("expected_quantity"),
        F.col("c.expected_unit_price").alias("expected_unit_price"),
    )


def unmatched_invoice_lines(invoices: DataFrame, lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Line indices without a partner; every line of an order that has no lines."""
    picked = chosen.select("stem", F.col("c.line_index").alias("line_index"))
    return (
        lines.join(linked(invoices).select("stem"), "stem", "left_semi")
        .select("stem", "line_index").join(picked, ["stem", "line_index"], "left_anti")
    )


def unmatched_po_lines(found: DataFrame) -> DataFrame:
    """Order lines no invoice line consumed, per invoice."""
    return found.filter(F.col("role") == LEFT).select("stem", "po_pos", F.col("left_number").alias("po_line_number"))
