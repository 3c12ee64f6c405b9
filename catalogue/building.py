"""Queries and oracles: table grids, responses, custom fields, prompts.

Grids and responses are laid out by Spark from the invoice lines; the oracles state what each layout
must yield, straight from the lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.fixture_sql import with_views
from ledgerloom.operators import grids as G
from ledgerloom.operators import invoices as D
from ledgerloom.operators import suppliers as SUP

QUERIES, ORACLES = {}, {}
BUYERS = [("Moyaware", "22 234 567 789")]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _money(c: str):
    return F.concat(F.lit("$"), F.format_number(F.col(c).cast("decimal(18,0)") / 100, 2))


def raw_grids(spark, sf):
    """(stem, table_idx, rows): six layouts, chosen by order key."""
    def build():
        lin = I.view(spark, sf, "lin")
        line = F.struct(
            "line_index", F.coalesce("sku", F.lit("")).alias("sku"), "description", F.col("qty").cast("string").alias("qty"),
            _money("unit_cents").alias("price"), F.coalesce(_money("raw_cents"), F.lit("-")).alias("total"),
            F.when(F.col("line_index") > 0, F.concat(F.lit("JR-"), (F.col("ok") % 100).cast("string"))).otherwise(F.lit("")).alias("jr"),
        )
        docs = lin.groupBy("ok", "stem").agg(F.array_sort(F.collect_list(line)).alias("ls"))
        lit = lambda *xs: F.array(*[F.lit(x) for x in xs])

        def table(idx: int, head, body):
            return F.struct(F.lit(idx).alias("table_idx"), F.concat(F.array(head), body).alias("rows"))

        def each(*cols):
            return F.transform("ls", lambda x: F.array(*[x[c] if isinstance(c, str) else c for c in cols]))

        def joined(c):
            return F.array_join(F.transform("ls", lambda x: x[c]), "\n")

        h4 = lit("Description", "Qty", "Unit Price", "Net Amount")
        l0 = table(0, lit("Item No", "Description", "Qty", "Unit Price", "Amount", "Job Ref"), each("sku", "description", "qty", "price", "total", "jr"))
        l1 = table(0, lit("Item Code, Description & Serial", "Qty/Hours", "Rate", "Line Total"), each("description", "qty", "price", "total"))
        l2 = table(0, lit("Description", "Qty", "Unit Price", "Total"), F.array(F.array(joined("description"), joined("qty"), joined("price"), joined("total"))))
        l3 = table(0, lit("Part No", "Details", "Quantity", "Each", "Price", "Total"), F.flatten(F.transform("ls", lambda x: F.array(
            F.array(x["sku"], x["description"], x["qty"], F.lit("ea"), x["price"], x["total"]),
            F.array(F.lit(""), F.concat(F.lit("continued "), x["line_index"].cast("string")), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("")),
        ))))
        body4 = each("description", "qty", "price", "total")
        l4 = table(0, h4, F.concat(F.slice(body4, 1, 1), F.array(h4), F.slice(body4, F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), F.array(lit("Subtotal", "", "", "$1,234.00"))))
        l5a = table(0, lit("Description", "Item No", "Qty", "Rate", "Amount"), each("description", "sku", "qty", "price", F.lit("")))
        l5b = table(1, lit("Particulars", "Qty", "Amount"), each("description", "qty", "total"))
        k = F.col("ok") % 6
        tables = F.when(k == 0, F.array(l0)).when(k == 1, F.array(l1)).when(k == 2, F.array(l2)).when(k == 3, F.array(l3)).when(k == 4, F.array(l4)).otherwise(F.array(l5a, l5b))
        return docs.select("ok", "stem", F.explode(tables).alias("t")).select("ok", "stem", "t.*")

    return I._once(spark, sf, "raw_grids", build)


def rows(spark, sf):
    return G.grid_rows(raw_grids(spark, sf))


LIN = with_views("lin")


def mny(c: str) -> str:
    return f"'$' || format('{{:,.2f}}', {c}/100.0)"


TXT = LIN + f""",
  t as (select ok, stem, line_index, coalesce(sku,'') as sku, description, cast(qty as varchar) as qty, {mny('unit_cents')} as price, coalesce({mny('raw_cents')},'-') as total,
    case when line_index>0 then 'JR-' || ok%100 else '' end as jr, raw_cents, qty as q, unit_cents, sku as real_sku, ok%6 as k,
    count(*) over (partition by ok) as n from lin)"""


def _cells(k: int, table: int, row: str, heads: list[str], vals: list[str], src: str = "t") -> str:
    hs = ", ".join("'" + h + "'" for h in heads)
    return (f"select stem, {k} as k, {table} as table_idx, {row} as row_idx, unnest(range(0, {len(heads)})) as c, unnest([{hs}]) as header, "
            f"unnest([{', '.join(vals)}]) as value from {src} where k={k}")


H3 = ["Part No", "Details", "Quantity", "Each", "Price", "Total"]
H4 = ["Description", "Qty", "Unit Price", "Net Amount"]
RECORDS = TXT + """,
  st as (select stem, k, string_agg(description, chr(10) order by line_index) as d, string_agg(qty, chr(10) order by line_index) as q2,
    string_agg(price, chr(10) order by line_index) as p, string_agg(total, chr(10) order by line_index) as tt, max(n) as n from t group by 1,2),
  recs as (""" + " union all ".join([
    _cells(0, 0, "line_index+1", ["Item No", "Description", "Qty", "Unit Price", "Amount", "Job Ref"], ["sku", "description", "qty", "price", "total", "jr"]),
    _cells(1, 0, "line_index+1", ["Item Code, Description & Serial", "Qty/Hours", "Rate", "Line Total"], ["description", "qty", "price", "total"]),
    _cells(2, 0, "1", ["Description", "Qty", "Unit Price", "Total"], ["d", "q2", "p", "tt"], "st"),
    _cells(3, 0, "2*line_index+1", H3, ["sku", "description", "qty", "'ea'", "price", "total"]),
    _cells(3, 0, "2*line_index+2", H3, ["''", "'continued ' || line_index", "''", "''", "''", "''"]),
    _cells(4, 0, "case when line_index=0 then 1 else line_index+2 end", H4, ["description", "qty", "price", "total"]),
    _cells(4, 0, "2", H4, ["'" + h + "'" for h in H4], "st"),
    _cells(4, 0, "n+2", H4, ["'Subtotal'", "''", "''", "'$1,234.00'"], "st"),
    _cells(5, 0, "line_index+1", ["Description", "Item No", "Qty", "Rate", "Amount"], ["description", "sku", "qty", "price", "''"]),
    _cells(5, 1, "line_index+1", ["Particulars", "Qty", "Amount"], ["description", "qty", "total"]),
]) + ")"


@query("raw_grid_records", RECORDS + " select stem, cast(table_idx as bigint) as table_idx, cast(row_idx as bigint) as row_idx, header, value from recs")
def raw_grid_records(spark, sf):
    r = rows(spark, sf)
    h = G.headers(r)
    cells = r.filter("row_idx > 0").join(h, G.TABLE).select(*G.TABLE, "row_idx", "headers", F.posexplode("cells").alias("c", "value"))
    return cells.select("stem", F.col("table_idx").cast("bigint").alias("table_idx"), "row_idx", F.get("headers", F.col("c")).alias("header"), "value")


DOCS = TXT + """, docs as (select stem, k, max(n) as n from t group by 1,2),
  scores as (select stem, 0 as table_idx, case k when 0 then 6 when 1 then 5 when 2 then 5 when 3 then 7 when 4 then 5 else 6 end
     + case when k in (3,4) or (k<>2 and n>=2) then 1 else 0 end as score, k from docs
   union all select stem, 1, 4 + case when n>=2 then 1 else 0 end, k from docs where k=5)"""


@query("header_scores", DOCS + " select stem, cast(table_idx as bigint) as table_idx, cast(score as bigint) as score from scores")
def header_scores(spark, sf):
    t = G.scored_headers(G.headers(rows(spark, sf)), I.PARAMS)
    return t.select("stem", F.col("table_idx").cast("bigint").alias("table_idx"), F.col("score").cast("bigint").alias("score"))


@query("header_map", DOCS + """ select stem, cast(table_idx as bigint) as table_idx, case when k=5 and table_idx=1 then 'description|quantity|total'
   else case k when 0 then 'sku|description|quantity|unit_price|total|' when 1 then 'description|quantity|unit_price|total' when 2 then 'description|quantity|unit_price|total'
     when 3 then 'sku|description|quantity|unit|unit_price|total' when 4 then 'description|quantity|unit_price|total' else 'description|sku|quantity|unit_price|total' end end as fields from scores""")
def header_map(spark, sf):
    t = G.scored_headers(G.headers(rows(spark, sf)), I.PARAMS)
    return t.select("stem", F.col("table_idx").cast("bigint").alias("table_idx"),
                    F.array_join(F.transform("fields", lambda f: F.coalesce(f, F.lit(""))), "|").alias("fields"))


EXPECTED = TXT + """,
  islands as (select *, sum(case when raw_cents is null then 0 else 1 end) over (partition by ok order by line_index) as isl from t),
  conts as (select stem, isl, string_agg('continued ' || line_index, ' ' order by line_index) as c from islands where k=3 group by 1,2),
  items as (select i.stem, i.isl-1 as line_index, case when k=3 then 2*line_index+1 else line_index+1 end as line_number,
     case when k in (0,3) then real_sku end as sku, case when k=3 then description || ' ' || c else description end as description,
     case when k=3 then 'ea' end as unit, q as quantity, case when k<>5 then unit_cents end as unit_cents, raw_cents as total_cents, k
   from islands i left join conts using (stem, isl) where raw_cents is not null)"""


def items_out(df):
    return df.select("stem", "line_index", F.col("line_number").cast("bigint").alias("line_number"), "sku", "description", "unit",
                     F.col("quantity").cast("bigint").alias("quantity"), F.floor(F.col("unit_price") * 100).cast("bigint").alias("unit_cents"),
                     F.floor(F.col("total") * 100).cast("bigint").alias("total_cents"))


ITEMS_OUT = "stem, cast(line_index as bigint) as line_index, cast(line_number as bigint) as line_number, sku, description, unit, quantity, unit_cents, total_cents"


@query("line_items_from_grid", EXPECTED + f" select {ITEMS_OUT} from items")
def line_items_from_grid(spark, sf):
    return items_out(G.line_items(rows(spark, sf), I.PARAMS))


@query("best_table", EXPECTED + """ select stem, cast(case when k=5 then 1 else 0 end as bigint) as table_idx, count(*) as n_items from items group by 1,2""")
def best_table(spark, sf):
    r = rows(spark, sf)
    t = G.scored_headers(G.headers(r), I.PARAMS).filter("score >= 2")
    items = G.merged_items(G.typed_rows(G.stacked_rows(r, t), I.PARAMS))
    return items.join(G.best_tables(items).select(*G.TABLE), G.TABLE, "left_semi").groupBy(
        "stem", F.col("table_idx").cast("bigint").alias("table_idx")).agg(F.count(F.lit(1)).alias("n_items"))


@query("stacked_rows", RECORDS + """
 select stem, cast(table_idx as bigint) as table_idx, cast(row_idx as bigint) as row_idx, cast(0 as bigint) as sub, value as first_value from recs where c=0 and k<>2
 union all select stem, 0, 1, line_index, description from t where k=2""")
def stacked_rows(spark, sf):
    r = rows(spark, sf)
    s = G.stacked_rows(r, G.scored_headers(G.headers(r), I.PARAMS))
    return s.select("stem", F.col("table_idx").cast("bigint").alias("table_idx"), "row_idx", F.col("sub").cast("bigint").alias("sub"),
                    F.get("values", F.lit(0)).alias("first_value"))


@query("continuation_merge", EXPECTED + " select stem, line_index, description from items")
def continuation_merge(spark, sf):
    r = rows(spark, sf)
    t = G.scored_headers(G.headers(r), I.PARAMS)
    return G.merged_items(G.typed_rows(G.stacked_rows(r, t), I.PARAMS)).select("stem", "line_index", "description")


def responses(spark, sf):
    """Model answers as text: fenced, with trailing commas, chatty or truncated, by order key."""
    def build():
        h, lin = I.view(spark, sf, "hdr"), I.view(spark, sf, "lin")
        c = lambda x: (F.col(x).cast("decimal(18,0)") / 100).cast("decimal(18,2)")
        item = F.struct("line_index", (F.col("line_index") + 1).alias("line_number"), "sku", "description", F.col("qty").alias("quantity"),
                        c("unit_cents").alias("unit_price"), c("raw_cents").alias("total"))
        per = lin.groupBy("ok").agg(F.array_sort(F.collect_list(item)).alias("line_items"))
        body = F.to_json(F.struct(
            "invoice_number", "invoice_date", "due_date",
            F.struct(F.col("inv_name").alias("name"), F.col("inv_abn").alias("abn"), F.col("inv_acn").alias("acn"), F.col("inv_email").alias("email")).alias("supplier"),
            F.col("po_ref").alias("po_number"), F.coalesce("line_items", F.array().cast(per.schema["line_items"].dataType)).alias("line_items"),
            c("subtotal_cents").alias("subtotal"), F.lit(0.1).alias("tax_rate"), c("tax_cents").alias("tax_amount"), c("total_cents").alias("total"),
        ))
        k = F.col("ok")
        text = (
            F.when(k % 41 == 0, F.substring("body", 1, 60))
            .when(k % 5 == 0, F.concat(F.lit("```json\n"), "body", F.lit("\n```")))
            .when(k % 5 == 1, F.regexp_replace(F.regexp_replace("body", r"\}$", ", }"), r"\]", ",]"))
            .when(k % 5 == 2, F.concat(F.lit("Here is the result:\n"), "body", F.lit("\nDone.")))
            .otherwise(F.col("body"))
        )
        return h.join(per, "ok", "left").withColumn("body", body).select("ok", "stem", text.alias("response"))

    return I._once(spark, sf, "responses", build)


HDR = with_views("hdr", "lin")


@query("response_parse", HDR + """
 select stem, invoice_number, invoice_date, due_date, inv_name as supplier_name, inv_abn as supplier_abn, po_ref as po_number, subtotal_cents, tax_cents, total_cents, 'AUD' as currency
 from hdr where ok%41 <> 0""")
def response_parse(spark, sf):
    inv = D.response_invoices(D.parse_responses(responses(spark, sf)))
    cents = lambda x: F.floor(F.col(x) * 100).cast("bigint")
    return inv.select("stem", "invoice_number", "invoice_date", "due_date", F.col("supplier.name").alias("supplier_name"), F.col("supplier.abn").alias("supplier_abn"),
                      "po_number", cents("subtotal").alias("subtotal_cents"), cents("tax_amount").alias("tax_cents"), cents("total").alias("total_cents"), "currency")


@query("response_lines", HDR + " select stem, line_index, sku, description, qty as quantity, unit_cents, raw_cents as total_cents from lin where ok%41 <> 0")
def response_lines(spark, sf):
    li = D.response_lines(D.parse_responses(responses(spark, sf)))
    return items_out(li).drop("line_number", "unit")


@query("parse_failures", HDR + " select stem from hdr where ok%41 = 0")
def parse_failures(spark, sf):
    return D.parse_failures(D.parse_responses(responses(spark, sf))).select("stem")


@query("line_source_merge", EXPECTED + """, with_table as (select distinct stem from items)
 select stem, 'table' as line_source, count(*) as n from items group by 1 union all
 select stem, 'response', count(*) from lin where ok%41 <> 0 and stem not in (select stem from with_table) group by 1""")
def line_source_merge(spark, sf):
    merged = D.merge_lines(G.line_items(rows(spark, sf), I.PARAMS), D.response_lines(D.parse_responses(responses(spark, sf))))
    return merged.groupBy("stem", "line_source").agg(F.count(F.lit(1)).alias("n"))


@query("second_pass_requests", HDR + """
 select stem, '22234567789' as abn_key, 'The previous answer named ''Moyaware'' (ABN: 22 234 567 789) as the supplier. That company is the buyer. Find the party that issued this invoice.' as correction_hint
 from hdr where variant=9""")
def second_pass_requests(spark, sf):
    return D.second_pass_requests(SUP.flag_internal(I.invoices(spark, sf), I.internal(spark, sf)))


PROMPT_HEAD = """'\nThese companies are the buyer, never the supplier:\n- BUYER NAME: Moyaware (ABN: 22 234 567 789)\n\nAlso fill "custom_fields":\n- bsb: Bank BSB number\n- contact: Contact e-mail\nUse null where absent.\n'"""


@query("prompts", f"""
 select 'doc_' || doc_id as stem, case when doc_id%2=0 then 'Extract the header fields of this invoice as JSON; set "line_items" to [].'
   else 'Extract the header fields and all line items of this invoice as JSON.' end || {PROMPT_HEAD}
   || case when doc_id%10=3 then '\nCORRECTION: look again' else '' end || '\nInvoice:\n' || text as prompt from documents""")
def prompts(spark, sf):
    k = F.col("doc_id")
    docs = I.base(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), k.cast("string")).alias("stem"), F.col("text").alias("markdown"), (k % 2 == 0).alias("has_lines"),
        F.when(k % 10 == 3, F.lit("look again")).alias("correction_hint"),
    )
    return D.prompts(docs, BUYERS, I.PARAMS.custom_fields)


REGEX_SQL = """regex as (select doc_id, nullif(trim(regexp_extract(text, '(\\d{3}[-\\s]\\d{3})', 1)),'') as bsb,
   nullif(trim(regexp_extract(text, '([a-z0-9.]+@[a-z0-9.]+)', 1, 'i')),'') as contact from documents)"""


def regex_values(spark, sf):
    docs = I.base(spark, sf, "documents").select("doc_id", "text")
    return D.regex_fields(docs, "text", I.PARAMS.custom_fields)


@query("custom_regex", "with " + REGEX_SQL + " select doc_id, bsb, contact from regex")
def custom_regex(spark, sf):
    return regex_values(spark, sf)


@query("custom_table_key", TXT + " select distinct stem, 'batch' as name, jr as value from t where k=0 and jr<>''")
def custom_table_key(spark, sf):
    r = rows(spark, sf)
    return D.table_fields(r, G.headers(r), I.PARAMS.custom_fields)


MERGE_SQL = TXT + ", " + REGEX_SQL + """,
  parts as (select 'inv_' || doc_id as stem, 'bsb' as name, bsb as value, 0 as rank, 'regex' as origin from regex where bsb is not null
   union all select 'inv_' || doc_id, 'contact', contact, 0, 'regex' from regex where contact is not null
   union all select distinct stem, 'batch', jr, 1, 'table' from t where k=0 and jr<>''
   union all select distinct 'inv_' || o_orderkey, 'bsb', '123-' || lpad(cast(o_orderkey%1000 as varchar),3,'0'), 2, 'response' from orders where o_orderkey%3=0)"""


@query("custom_merge", MERGE_SQL + " select stem, name, arg_min(value, rank) as value, arg_min(origin, rank) as origin from parts group by 1,2")
def custom_merge(spark, sf):
    vals = regex_values(spark, sf)
    by_regex = vals.select(F.concat(F.lit("inv_"), F.col("doc_id").cast("string")).alias("stem"),
                           F.explode(F.create_map(F.lit("bsb"), F.col("bsb"), F.lit("contact"), F.col("contact"))).alias("name", "value")).filter("value is not null")
    by_response = I.invoices(spark, sf).select("stem", F.explode("custom_fields").alias("name", "value"))
    return D.merge_custom(by_regex, custom_table_key(spark, sf), by_response)
