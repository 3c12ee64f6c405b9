"""Queries and oracles: locating values in document elements, master-data maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.fixture_sql import with_views
from ledgerloom.operators import grounding as G
from ledgerloom.operators import maintenance as MT
from ledgerloom.operators.ordinals import numbered

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def elements(spark, sf):
    """Text elements of each invoice: headings, a supplier name over two elements, then table cells."""
    def build():
        h, lin = I.view(spark, sf, "hdr"), I.view(spark, sf, "lin")
        money = lambda c: F.format_number(F.col(c).cast("decimal(18,0)") / 100, 2)
        iso = F.col("iso")
        shown = F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4))
        name = F.coalesce("inv_name", F.lit(""))
        space = F.instr(name, " ")
        head = F.array(
            F.concat(F.lit("Invoice No: "), F.coalesce("invoice_number", F.lit("-"))), F.concat(F.lit("Date: "), shown),
            F.when(space > 0, F.substr(name, F.lit(1), space - 1)).otherwise(name), F.when(space > 0, F.substr(name, space + 1)).otherwise(F.lit("")),
            F.concat(F.lit("Total: $"), F.coalesce(money("total_cents"), F.lit("-"))),
        )
        none = F.lit(None).cast("int")
        heads = h.select("stem", F.posexplode(head).alias("p", "text")).select(
            "stem", F.col("p").cast("bigint").alias("el_idx"), "text", F.lit("text").alias("type"), none.alias("table_index"), none.alias("row_index"))
        cells = lin.select("stem", "line_index", F.posexplode(F.array("description", F.col("qty").cast("string"), money("unit_cents"), money("line_cents"))).alias("p", "text")).select(
            "stem", (F.col("line_index") * 4 + F.col("p") + 5).alias("el_idx"), "text", F.lit("table_cell").alias("type"),
            F.lit(0).alias("table_index"), (F.col("line_index") + 1).cast("int").alias("row_index"))
        both = heads.unionByName(cells)
        box = F.array(*[F.col("el_idx").cast("double") + i for i in range(4)])
        return both.withColumn("page", F.lit(1)).withColumn("bbox", box).withColumn("origin", F.lit("TOPLEFT"))

    return I._once(spark, sf, "elements", build)


def values(spark, sf):
    inv = I.invoices(spark, sf).join(I.view(spark, sf, "hdr").select("stem", "iso"), "stem").withColumn("invoice_date", F.col("iso"))
    return G.field_values(inv, I.lines(spark, sf))


def _n(c: str) -> str:
    return f"regexp_replace(cast(cast(({c})/100.0 as decimal(18,4)) as varchar), '0{{1,3}}$', '')"


def _norm(c: str) -> str:
    k = f"regexp_replace({c},'[^0-9.]','','g')"
    return f"case when contains({k},'.') then rtrim(rtrim({k},'0'),'.') else {k} end"


# The given data is ASCII; RE2 compiles the ASCII class far faster than Unicode classes.
GAP, DGAP = "[^a-z0-9]*", "[^a-z0-9.]*"
ELEMENTS = with_views("hdr", "lin") + """,
  nm as (select *, coalesce(inv_name,'') as nm from hdr),
  els as (select stem, unnest(range(0,5)) as el_idx, unnest(['Invoice No: ' || coalesce(invoice_number,'-'), 'Date: ' || substr(iso,9,2) || '/' || substr(iso,6,2) || '/' || substr(iso,1,4),
      split_part(nm,' ',1), case when contains(nm,' ') then substr(nm, strpos(nm,' ')+1) else '' end, 'Total: $' || coalesce(format('{:,.2f}', total_cents/100.0),'-')]) as text,
      'text' as type, cast(null as bigint) as row_index from nm
    union all select stem, line_index*4+5+unnest(range(0,4)), unnest([description, cast(qty as varchar), format('{:,.2f}', unit_cents/100.0), format('{:,.2f}', line_cents/100.0)]), 'table_cell', line_index+1 from lin),
  vals as (select * from (
    select stem, unnest(['invoice_number','invoice_date','po_number','due_date','total','subtotal','tax_amount','supplier.name','supplier.abn','supplier.email']) as field_path, null::bigint as line_index, null as field,
      unnest([invoice_number, iso, po_ref, due_date, """ + ", ".join(_n(c) for c in ("total_cents", "subtotal_cents", "tax_cents")) + """,
        case when variant<>7 then inv_name end, case when variant<>7 then inv_abn end, case when variant<>7 then inv_email end]) as value,
      unnest(['text','text','text','text',null,null,null,'text','text','text']) as preferred from hdr
    union all select stem, 'custom_fields.bsb', null, null, '123-' || lpad(cast(ok%1000 as varchar),3,'0'), null from hdr where ok%3=0
    union all select stem, 'line_items[' || line_index || '].' || f, line_index, f, v, 'table_cell' from (select stem, line_index, unnest(['description','sku','quantity','unit_price','total']) as f,
      unnest([description, sku, """ + ", ".join((_n("qty*100"), _n("unit_cents"), _n("line_cents"))) + """]) as v from lin)) where value is not null),
  tries as (select *, trim(value) as val, case when (regexp_full_match(trim(value),'-?\\d+\\.?\\d*') or regexp_full_match(replace(trim(value),'.',''),'\\d+'))
      and length(split_part(trim(value),'.',1))>1 and split_part(trim(value),'.',1)<>trim(value) then split_part(trim(value),'.',1) end as fallback from vals),
  v as (select distinct stem, val, regexp_full_match(val,'-?\\d+\\.?\\d*') as is_num, regexp_full_match(val,'\\d{4}-\\d{2}-\\d{2}') as is_date
     from (select stem, val from tries union all select stem, fallback from tries where fallback is not null) where val<>''),
  ex as (select v.stem, val, min(el_idx) as el from v join els e on e.stem=v.stem and contains(text,val)
     and (not is_num or regexp_matches(' ' || text || ' ', '[^0-9.]' || replace(val,'.','\\.') || '[^0-9.]')) group by 1,2),
  forms as (select stem, val, unnest(range(0,4)) as r, unnest([d || '/' || m || '/' || y, d || '-' || m || '-' || y, d || ' ' || m || ' ' || y, d || m || y]) as form
     from (select stem, val, substr(val,1,4) as y, substr(val,6,2) as m, substr(val,9,2) as d from v where is_date)),
  dt as (select f.stem, val, arg_min(el_idx, (r, el_idx)) as el from forms f join els e on e.stem=f.stem and contains(text, form) group by 1,2),
  nu as (select v.stem, val, min(el_idx) as el from v join els e on e.stem=v.stem and is_num and """ + _norm("val") + " = " + _norm("text") + " and " + _norm("val") + """ <> '' group by 1,2),
  direct as (select v.*, case when ex.el is not null then 'exact' when dt.el is not null then 'date' when nu.el is not null then 'number' end as strategy, coalesce(ex.el, dt.el, nu.el) as el_idx
     from v left join ex using (stem,val) left join dt using (stem,val) left join nu using (stem,val)),
  stream as (select stem, lower(string_agg(text,' ' order by el_idx)) || ' ' as stream from els group by 1),
  offs as (select stem, el_idx, sum(length(text)+1) over (partition by stem order by el_idx) - length(text) - 1 as s0, sum(length(text)+1) over (partition by stem order by el_idx) as e0 from els),
  chars as (select stem, val, is_num, is_date, 0 as r, case when is_num then """ + _norm("val") + """ when is_date then substr(val,9,2) || substr(val,6,2) || substr(val,1,4) else regexp_replace(lower(val),'[^a-z0-9]','','g') end as tgt from direct where strategy is null
     union all select stem, val, is_num, is_date, 1, substr(val,6,2) || substr(val,9,2) || substr(val,1,4) from direct where strategy is null and is_date
     union all select stem, val, is_num, is_date, 2, regexp_replace(val,'[^0-9]','','g') from direct where strategy is null and is_date),
  pats as (select *, case when is_num then array_to_string(list_transform(string_split(tgt,''), lambda c: replace(c,'.','\\.')), '""" + DGAP + """') else array_to_string(string_split(tgt,''), '""" + GAP + """') end as pat from chars where tgt<>''),
  located as (select p.stem, p.val, p.r, case when is_num then regexp_extract(' ' || stream, '(?s)^(.*?[^0-9])' || pat || '[^0-9]', 1) else regexp_extract(' ' || stream, '(?s)^(.*?)' || pat, 1) end as pre,
     case when is_num then regexp_matches(' ' || stream, '[^0-9]' || pat || '[^0-9]') else regexp_matches(stream, pat) end as hit, pat, stream, is_num from pats p join stream using (stem)),
  span as (select stem, val, arg_min(length(pre)-1, r) as s, arg_min(length(pre)-1 + length(regexp_extract(substr(' ' || stream, length(pre)+1), '(?s)^(' || pat || ')', 1)), r) as e from located where hit group by 1,2),
  hits as (select stem, val, strategy, el_idx from direct where strategy is not null union all
     select sp.stem, sp.val, 'stream', o.el_idx from span sp join offs o on o.stem=sp.stem and o.s0 < sp.e and o.e0 > sp.s)"""


@query("ground_values", ELEMENTS + " select stem, val, strategy, cast(el_idx as bigint) as el_idx from hits")
def ground_values(spark, sf):
    vals = values(spark, sf)
    return G.find_values(_with_fallback(vals), elements(spark, sf))


def _with_fallback(vals):
    whole = F.trim("value")
    integer = F.split_part(whole, F.lit("."), F.lit(1))
    shorter = whole.rlike(G.NUMERIC) & (F.length(integer) > 1) & (integer != whole)
    return vals.select("stem", F.explode(F.when(shorter, F.array("value", integer)).otherwise(F.array("value"))).alias("value"))


def _keyed(spark, sf):
    return G.stripped_values(_with_fallback(values(spark, sf)))


@query("ground_exact", ELEMENTS + " select stem, val, cast(el as bigint) as el from ex")
def ground_exact(spark, sf):
    return G.exact_hits(_keyed(spark, sf), elements(spark, sf))


@query("ground_date", ELEMENTS + " select stem, val, cast(el as bigint) as el from dt")
def ground_date(spark, sf):
    return G.date_hits(_keyed(spark, sf), elements(spark, sf))


@query("ground_numeric", ELEMENTS + " select stem, val, cast(el as bigint) as el from nu")
def ground_numeric(spark, sf):
    return G.number_hits(_keyed(spark, sf), elements(spark, sf))


@query("ground_offsets", ELEMENTS + " select stem, cast(el_idx as bigint) as el_idx, cast(s0 as bigint) as start, cast(e0 as bigint) as \"end\" from offs")
def ground_offsets(spark, sf):
    return G.offsets(elements(spark, sf))


FOUND = ELEMENTS + """,
  found as (select t.stem, t.field_path, t.line_index, t.field, t.preferred, 0 as attempt, h.el_idx, e.type, e.row_index from tries t join hits h on h.stem=t.stem and h.val=t.val join els e on e.stem=h.stem and e.el_idx=h.el_idx
    union all select t.stem, t.field_path, t.line_index, t.field, t.preferred, 1, h.el_idx, e.type, e.row_index from tries t join hits h on h.stem=t.stem and h.val=t.fallback join els e on e.stem=h.stem and e.el_idx=h.el_idx),
  anchor as (select stem, line_index, arg_min(row_index, el_idx) as a_row from found where field='description' and attempt=0 and type='table_cell' group by 1,2),
  lockd as (select f.*, coalesce(field<>'description' and attempt=0 and type='table_cell' and row_index=a_row, false) as in_row from found f left join anchor a on a.stem=f.stem and a.line_index=f.line_index),
  graded as (select *, case when in_row then 0 else 1+attempt*2+case when coalesce(type=preferred,false) then 0 else 1 end end as g from lockd)"""


@query("ground_fields", FOUND + " select stem, field_path, cast(el_idx as bigint) as el_idx from graded qualify g = min(g) over (partition by stem, field_path)")
def ground_fields(spark, sf):
    return G.ground_fields(values(spark, sf), elements(spark, sf))


@query("ground_line_rows", FOUND + " select stem, field_path, cast(el_idx as bigint) as el_idx, 1 as page, cast(el_idx as double) as x0 from graded where line_index is not null qualify g = min(g) over (partition by stem, field_path)")
def ground_line_rows(spark, sf):
    vals = values(spark, sf).filter("line_index is not null")
    boxes = G.field_boxes(G.ground_fields(vals, elements(spark, sf)), elements(spark, sf))
    return boxes.select("stem", "field_path", "el_idx", "page", F.get("bbox", F.lit(0)).alias("x0"))


@query("ground_stream", ELEMENTS + " select stem, val, cast(el_idx as bigint) as el_idx from hits where strategy='stream'")
def ground_stream(spark, sf):
    found = G.find_values(_with_fallback(values(spark, sf)), elements(spark, sf))
    return found.filter("strategy = 'stream'").select("stem", "val", "el_idx")


# All lines of a nation's customers as one document: as many lines as a twenty-fifth of the table.
LARGE = with_views("lin") + """,
  big as (select 'nat_' || c_nationkey as stem, row_number() over (partition by c_nationkey order by lin.ok, line_index) - 1 as k, lin.ok, sku, description, qty, line_cents
     from lin join orders on o_orderkey=lin.ok join customer on c_custkey=o_custkey),
  els as (select stem, k*4+unnest(range(0,4)) as el_idx, unnest([coalesce(sku,'-'), split_part(description,' ',1) || ' ' || split_part(description,' ',2),
      substr(description, strpos(substr(description, strpos(description,' ')+1),' ')+strpos(description,' ')+1), cast(qty as varchar) || ' @ ' || format('{:,.2f}', line_cents/100.0)]) as text from big),
  vals as (select distinct stem, trim(val) as val from (select stem, unnest([sku, 'Ref ' || ok, split_part(description,' ',3) || ' ' || split_part(description,' ',4)]) as val from big) where trim(val)<>''),
  seen as (select stem, text, min(el_idx) as el_idx from els group by 1,2),
  words as (select stem, val, min(el_idx) as el_idx from vals join seen using (stem) where contains(text, val) group by 1,2)"""


def large_elements(spark, sf):
    """Elements of documents that grow with the table; a line's description stands in two elements."""
    def build():
        lines = _large(spark, sf)
        words = F.split("description", " ")
        cut = F.array_join(F.slice(words, 1, 2), " ")
        cells = F.array(F.coalesce("sku", F.lit("-")), cut, F.substr("description", F.length(cut) + 2),
                        F.concat(F.col("qty").cast("string"), F.lit(" @ "), F.format_number(F.col("line_cents").cast("decimal(18,0)") / 100, 2)))
        return lines.select("stem", F.posexplode(cells).alias("p", "text"), "k").select("stem", (F.col("k") * 4 + F.col("p")).alias("el_idx"), "text")

    return I._once(spark, sf, "large-elements", build)


def _large(spark, sf):
    def build():
        orders, customers = I.base(spark, sf, "orders"), I.base(spark, sf, "customer")
        stems = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("ok"), F.concat(F.lit("nat_"), F.col("c_nationkey").cast("string")).alias("stem"))
        lines = I.view(spark, sf, "lin").select("ok", "line_index", "sku", "description", "qty", "line_cents").join(stems, "ok")
        return numbered(lines.withColumn("at", F.col("ok") * 1024 + F.col("line_index")), ["stem"], "at", "k", 22).withColumn("k", F.col("k") - 1)

    return I._once(spark, sf, "large-lines", build)


def large_values(spark, sf):
    words = F.split("description", " ")
    cells = F.array("sku", F.concat(F.lit("Ref "), F.col("ok").cast("string")), F.array_join(F.slice(words, 3, 2), " "))
    return _large(spark, sf).select("stem", F.explode(cells).alias("value")).filter("value is not null")


@query("ground_large", LARGE + " select stem, val, cast(el_idx as bigint) as el_idx from words")
def ground_large(spark, sf):
    """Texts in documents of many thousand lines, element by element."""
    found = G.exact_hits(G.distinct_values(large_values(spark, sf)), large_elements(spark, sf))
    return found.select("stem", "val", F.col("el").alias("el_idx"))


SUPPLIERS = with_views("sup") + """,
  fresh as (select c_custkey as ord, case when c_custkey%3=0 then substr(s.abn,1,2) || ' ' || substr(s.abn,3) when c_custkey%3=1 then '' else '99' || c_custkey end as abn,
     case when c_custkey%5=0 then '  ' || upper(t.name) || ' ' else 'New Trader ' || c_custkey end as name
   from customer left join sup s on s.supplier_ord=c_custkey%50 left join sup t on t.supplier_ord=c_custkey%70)"""


def fresh(spark, sf):
    """New supplier requests: one per customer, some repeating a known number or name."""
    k = F.col("c_custkey")
    sup = I.view(spark, sf, "sup")
    a = sup.select(F.col("supplier_ord").alias("ao"), F.col("abn").alias("a_abn"))
    b = sup.select(F.col("supplier_ord").alias("bo"), F.col("name").alias("b_name"))
    c = I.base(spark, sf, "customer").select("c_custkey").join(a, k % 50 == F.col("ao"), "left").join(b, k % 70 == F.col("bo"), "left")
    abn = F.when(k % 3 == 0, F.concat(F.substring("a_abn", 1, 2), F.lit(" "), F.expr("substr(a_abn, 3)"))).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("99"), k.cast("string")))
    name = F.when(k % 5 == 0, F.concat(F.lit("  "), F.upper("b_name"), F.lit(" "))).otherwise(F.concat(F.lit("New Trader "), k.cast("string")))
    empty = F.lit("")
    return c.select(k.alias("ord"), name.alias("name"), abn.alias("abn"), *[empty.alias(x) for x in ("acn", "email", "phone", "address")])


@query("next_supplier_codes", SUPPLIERS + """
 select 'SUP-' || ((select max(try_cast(substr(supplier_id,5) as bigint)) from sup) + row_number() over (order by ord)) as id, trim(coalesce(name,'')) as name, trim(coalesce(abn,'')) as abn, '' as aliases from fresh""")
def next_supplier_codes(spark, sf):
    return MT.new_suppliers(fresh(spark, sf), master_rows(spark, sf), "SUP-").select("id", "name", "abn", "aliases")


def master_rows(spark, sf):
    return I.view(spark, sf, "sup").select(F.col("supplier_ord").alias("ord"), F.col("supplier_id").alias("id"), "name", "abn")


@query("supplier_duplicates", SUPPLIERS + """,
  dup as (select f.ord, s.supplier_ord, case when replace(f.abn,' ','')<>'' and replace(s.abn,' ','')=replace(f.abn,' ','') then 0 else 1 end as rule, s.supplier_id, s.name as master_name
    from fresh f join sup s on (replace(f.abn,' ','')<>'' and replace(s.abn,' ','')=replace(f.abn,' ','')) or lower(trim(s.name))=lower(trim(f.name)))
 select ord, arg_min(case when rule=0 then 'A supplier with this ABN already exists: ' || master_name || ' (' || supplier_id || ')' else 'A supplier with this name already exists (' || supplier_id || ')' end, (supplier_ord, rule)) as warning
 from dup group by 1""")
def supplier_duplicates(spark, sf):
    return MT.duplicate_warnings(fresh(spark, sf), master_rows(spark, sf)).select("ord", "warning")
