"""Queries and oracles: masters, scalar functions, supplier and order matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.fixture_sql import with_views
from ledgerloom.functions import scalars as S
from ledgerloom.functions.similarity import token_sort
from ledgerloom.operators import orders as O
from ledgerloom.operators import suppliers as SUP
from ledgerloom.params import MONEY
from ledgerloom.plans import reconcile as R
from ledgerloom.sources import masters as M

BIG, DBL = "bigint", "double"
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def cents_of(c: str) -> F.Column:
    return F.floor(F.col(c) * 100 + F.lit(0.5)).cast(BIG)


# DuckDB: LCS of distinct text pairs (a, b) by the bit-parallel recurrence on 64-bit integers.
def lcs_sql(pairs: str) -> str:
    return f"""
  lcs_pairs as (select distinct a, b from {pairs} where length(a) > 0 and length(b) > 0),
  lcs_masks as (select a, map(list(ch), list(m)) as masks from (
     select a, ch, cast(sum(1::bigint << (pos-1)) as bigint) as m
     from (select a, unnest(string_split(a,'')) as ch, unnest(range(1, length(a)+1)) as pos from (select distinct a from lcs_pairs))
     group by a, ch) group by a),
  lcs_scored as (select p.a, p.b, length(p.a) - bit_count(list_reduce(
       list_prepend((1::bigint << length(p.a)) - 1,
         list_transform(string_split(p.b,''), lambda c: coalesce(map_extract(masks, c)[1], 0::bigint))),
       lambda v, m: ((v + (v & m)) | (v & ~m)) & ((1::bigint << length(p.a)) - 1))) as lcs
     from lcs_pairs p join lcs_masks k on k.a = p.a)"""


def tsort_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex(lower({c}), '\\s+'), lambda t: t <> '')), ' ')"


SUP_CLEAN = with_views("sup") + """,
  master as (select supplier_ord, supplier_id, name, abn, email, string_split(aliases, '|') as alias_list from sup),
  names as (select supplier_ord, supplier_id, 0 as name_ord, name as any_name from master
    union all select supplier_ord, supplier_id, unnest(range(1, len(alias_list)+1)), unnest(alias_list) from master)"""


@query("supplier_master", SUP_CLEAN + """
 select supplier_ord, supplier_id, name, abn, cast(null as varchar) as acn, email, cast(null as varchar) as phone,
  cast(null as varchar) as address, array_to_string(alias_list, '|') as aliases from master""")
def supplier_master(spark, sf):
    return M.supplier_master(I.supplier_rows(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@query("supplier_names", SUP_CLEAN + """
 select supplier_ord, supplier_id, cast(name_ord as bigint) as name_ord, any_name, lower(any_name) as name_key from names""")
def supplier_names(spark, sf):
    return SUP.supplier_names(I.suppliers(spark, sf)).withColumn("name_ord", F.col("name_ord").cast(BIG))


def po_rows(spark, sf):
    """Order headers as text rows, the way a file holds them."""
    none = F.lit("")
    return I.view(spark, sf, "po_rows").select(
        "ord", "po_number", "supplier_id", none.alias("supplier_name"), none.alias("issue_date"), none.alias("expected_delivery"),
        F.concat(F.lit("$"), (F.col("subtotal_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")).alias("subtotal"),
        none.alias("tax_amount"),
        (F.col("total_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("total"),
        none.alias("currency"), none.alias("status"), none.alias("notes"),
    )


def pol_rows(spark, sf):
    return I.view(spark, sf, "pol_rows").select(
        "ord", "po_number", F.col("line_number").cast("string").alias("line_number"), "sku", "description",
        F.col("qty").cast("string").alias("quantity"), F.lit("ea").alias("unit"),
        (F.col("unit_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("unit_price"),
        F.lit("n/a").alias("total"),
    )


PO_DEDUP = """
  po_last as (select upper(trim(po_number)) as po_key, arg_max(trim(po_number), ord) as po_number,
    arg_max(coalesce(nullif(supplier_id,''), '#'), ord) as sid, arg_max(subtotal_cents, ord) as subtotal_cents,
    arg_max(total_cents, ord) as total_cents from po_rows group by 1)"""


@query("po_headers_dedup", with_views("po_rows") + "," + PO_DEDUP + """
 select po_key, po_number, nullif(sid,'#') as supplier_id, subtotal_cents, total_cents, 'AUD' as currency from po_last""")
def po_headers_dedup(spark, sf):
    h = M.order_headers(po_rows(spark, sf))
    return h.select("po_key", "po_number", "supplier_id", cents_of("subtotal").alias("subtotal_cents"),
                    cents_of("total").alias("total_cents"), "currency")


@query("po_lines_linked", with_views("po_rows", "pol_rows") + "," + PO_DEDUP + """,
  kept as (select upper(trim(p.po_number)) as po_key, p.*, row_number() over (partition by upper(trim(p.po_number)) order by ord) - 1 as po_pos
    from pol_rows p where upper(trim(p.po_number)) in (select po_key from po_last)),
  firsts as (select po_key, line_number as n, arg_min(qty, po_pos) as q from kept where line_number is not null group by 1,2)
 select k.po_key, k.po_pos, cast(line_number as bigint) as line_number, sku, description, qty as quantity, unit_cents,
  0 as total_cents, f.q as expected_quantity
 from kept k left join firsts f on f.po_key=k.po_key and f.n=coalesce(k.line_number, k.po_pos+1)""")
def po_lines_linked(spark, sf):
    headers = M.order_headers(po_rows(spark, sf))
    rows = M.order_lines(pol_rows(spark, sf), headers)
    return rows.select("po_key", "po_pos", F.col("line_number").cast(BIG).alias("line_number"), "sku", "description",
                       F.col("quantity").cast(BIG).alias("quantity"), cents_of("unit_price").alias("unit_cents"),
                       cents_of("total").alias("total_cents"), F.col("expected_quantity").cast(BIG).alias("expected_quantity"))


@query("orphan_po_lines", with_views("po_rows", "pol_rows") + "," + PO_DEDUP + """
 select upper(trim(po_number)) as po_key, cast(line_number as bigint) as line_number, sku, qty as quantity from pol_rows
 where upper(trim(po_number)) not in (select po_key from po_last)""")
def orphan_po_lines(spark, sf):
    rows = M.orphan_lines(pol_rows(spark, sf), M.order_headers(po_rows(spark, sf)))
    return rows.select("po_key", F.col("line_number").cast(BIG).alias("line_number"), "sku", F.col("quantity").cast(BIG).alias("quantity"))


HDR = with_views("hdr")


@query("scalar_abn", HDR + """
 select stem, nullif(regexp_replace(coalesce(nullif(inv_abn,''), inv_acn),'[^0-9]','','g'),'') as abn_key from hdr""")
def scalar_abn(spark, sf):
    h = I.view(spark, sf, "hdr")
    return h.select("stem", S.registration_key(F.col("inv_abn"), F.col("inv_acn")).alias("abn_key"))


@query("scalar_domain", HDR + """
 select stem, case when contains(inv_email,'@') then lower(substr(inv_email, strpos(inv_email,'@')+1)) end as domain from hdr""")
def scalar_domain(spark, sf):
    return I.view(spark, sf, "hdr").select("stem", S.email_domain(F.col("inv_email")).alias("domain"))


@query("scalar_float", with_views("pol") + """
 , cells as (select po_number || '/' || line_number as id, case line_number%5 when 0 then '$' || qty || ',000.' || unit_cents%100
   when 1 then '-' || qty || '.' || unit_cents%10 || ' ea' when 2 then 'n/a - none' when 3 then qty || '.' || qty || '.1' else '' end as t from pol)
 select id, try_cast(regexp_replace(t,'[^0-9.\\-]','','g') as double) as num from cells""")
def scalar_float(spark, sf):
    q, u = F.col("qty").cast("string"), F.col("unit_cents")
    t = (
        F.when(F.col("line_number") % 5 == 0, F.concat(F.lit("$"), q, F.lit(",000."), (u % 100).cast("string")))
        .when(F.col("line_number") % 5 == 1, F.concat(F.lit("-"), q, F.lit("."), (u % 10).cast("string"), F.lit(" ea")))
        .when(F.col("line_number") % 5 == 2, F.lit("n/a - none"))
        .when(F.col("line_number") % 5 == 3, F.concat(q, F.lit("."), q, F.lit(".1")))
        .otherwise(F.lit(""))
    )
    pol = I.view(spark, sf, "pol")
    return pol.select(F.concat("po_number", F.lit("/"), F.col("line_number").cast("string")).alias("id"), S.to_number(t).alias("num"))


DATE_SQL = """case when regexp_full_match(trim({c}),'\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_strptime(trim({c}),'%Y-%m-%d')
   when regexp_full_match(trim({c}),'\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') then try_strptime(trim({c}),'%d/%m/%Y')
   when regexp_full_match(trim({c}),'\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') then try_strptime(trim({c}),'%d-%m-%Y')
   when regexp_full_match(trim({c}),'\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') then try_strptime(trim({c}),'%Y/%m/%d') end"""


def date_sql(c: str) -> str:
    return "cast(" + DATE_SQL.format(c=c) + " as date)"


@query("scalar_date", HDR + f" select stem, cast({date_sql('invoice_date')} as varchar) as parsed, cast({date_sql('due_date')} as varchar) as due from hdr")
def scalar_date(spark, sf):
    h = I.view(spark, sf, "hdr")
    return h.select("stem", S.parse_date(F.col("invoice_date")).cast("string").alias("parsed"), S.parse_date(F.col("due_date")).cast("string").alias("due"))


# Supplier cascade in SQL. The best similar name is the highest score, then the lowest supplier, then name.
CASCADE = with_views("hdr", "sup") + """,
  master as (select supplier_ord, supplier_id, name, abn, email, string_split(aliases, '|') as alias_list from sup),
  names as (select supplier_ord, 0 as name_ord, lower(name) as k from master
    union all select supplier_ord, unnest(range(1, len(alias_list)+1)), lower(unnest(alias_list)) from master),
  by_abn as (select abn as k, min(supplier_ord) as o from sup group by 1),
  by_name as (select k, min(supplier_ord) as o from names group by 1),
  by_domain as (select lower(substr(email, strpos(email,'@')+1)) as k, min(supplier_ord) as o from sup group by 1),
  keyed as (select ok, stem, variant, inv_name, inv_abn, inv_acn,
     nullif(regexp_replace(coalesce(nullif(inv_abn,''), inv_acn),'[^0-9]','','g'),'') as abn_key,
     nullif(lower(trim(inv_name)),'') as name_key,
     nullif(lower(substr(inv_email, strpos(inv_email,'@')+1)),'') as domain_key from hdr where variant <> 7),
  cheap as (select keyed.*, a.o as abn_o, n.o as name_o, d.o as domain_o from keyed
     left join by_abn a on a.k=abn_key left join by_name n on n.k=name_key left join by_domain d on d.k=domain_key),
  open_names as (select distinct name_key, """ + tsort_sql("name_key") + """ as a from cheap where abn_o is null and name_o is null and name_key is not null),
  cands as (select supplier_ord, name_ord, """ + tsort_sql("k") + """ as b from names),
  fz as (select a, b from open_names, (select distinct b from cands)),
""" + lcs_sql("fz") + """,
  fuzzy as (select name_key, arg_min(supplier_ord, (-200.0*lcs/(length(s.a)+length(s.b)), supplier_ord, name_ord)) as fuzzy_o, max(200.0*lcs/(length(s.a)+length(s.b))) as score
     from open_names n join lcs_scored s on s.a=n.a join cands c on c.b=s.b
     where 200*lcs >= 75*(length(s.a)+length(s.b)) group by 1),
  cascade as (select c.*, f.fuzzy_o, f.score, coalesce(abn_o, name_o, fuzzy_o, domain_o) as o,
     case when abn_o is not null then 'abn_exact' when name_o is not null then 'name_exact' when fuzzy_o is not null then 'name_fuzzy'
          when domain_o is not null then 'email_domain' end as match_method,
     case when abn_o is not null then 1.0::double when name_o is not null then 0.95::double when fuzzy_o is not null then score/100
          when domain_o is not null then 0.7::double end as confidence,
     case when abn_o is not null then coalesce(nullif(inv_abn,''),inv_acn) when name_o is not null then inv_name
          when fuzzy_o is not null then c.name_key when domain_o is not null then domain_key end as matched_value
     from cheap c left join fuzzy f on f.name_key=c.name_key)"""




@query("match_abn", CASCADE + " select stem, cast(abn_o as bigint) as supplier_ord from cascade where abn_o is not null")
def match_abn(spark, sf):
    b = I.invoices(spark, sf).filter("supplier is not null").select("stem", S.registration_key(F.col("supplier.abn"), F.col("supplier.acn")).alias("abn_key"))
    return b.join(SUP.abn_index(I.suppliers(spark, sf)), "abn_key").select("stem", "supplier_ord")


@query("match_name", CASCADE + " select stem, cast(name_o as bigint) as supplier_ord from cascade where name_o is not null")
def match_name(spark, sf):
    b = I.invoices(spark, sf).filter("supplier is not null").select("stem", S.name_key(F.col("supplier.name")).alias("name_key"))
    return b.join(SUP.name_index(I.suppliers(spark, sf)), "name_key").select("stem", "supplier_ord")


@query("match_domain", CASCADE + " select stem, cast(domain_o as bigint) as supplier_ord from cascade where domain_o is not null")
def match_domain(spark, sf):
    b = I.invoices(spark, sf).filter("supplier is not null").select("stem", S.email_domain(F.col("supplier.email")).alias("domain_key"))
    return b.join(SUP.domain_index(I.suppliers(spark, sf)), "domain_key").select("stem", "supplier_ord")


@query("match_fuzzy", CASCADE + " select name_key, cast(fuzzy_o as bigint) as supplier_ord, score from fuzzy")
def match_fuzzy(spark, sf):
    sup, P = I.suppliers(spark, sf), I.PARAMS
    blocks = SUP.supplier_blocks(I.invoices(spark, sf))
    known = blocks.join(SUP.abn_index(sup).select("abn_key"), "abn_key", "left_anti").join(SUP.name_index(sup).select("name_key"), "name_key", "left_anti")
    names = known.filter("name_key is not null").select("name_key").distinct()
    return SUP.fuzzy_best(names, sup, P.supplier_fuzzy_threshold)


@query("match_cascade", CASCADE + """
 select h.stem, m.supplier_id, m.name as supplier_name, c.match_method, c.confidence, m.abn, c.matched_value
 from hdr h left join cascade c on c.stem=h.stem left join sup m on m.supplier_ord=c.o""")
def match_cascade(spark, sf):
    m = SUP.match_suppliers(I.invoices(spark, sf), I.suppliers(spark, sf), I.PARAMS)
    s = "matched_supplier."
    return m.select("stem", *[F.col(s + c).alias(c) for c in ("supplier_id", "supplier_name", "match_method", "confidence", "abn")],
                    F.col(s + "matched_on.value").alias("matched_value"))


@query("internal_flag", HDR + """
 select stem, coalesce(variant = 9 and true, false) as is_internal from hdr""")
def internal_flag(spark, sf):
    return SUP.flag_internal(I.invoices(spark, sf), I.internal(spark, sf)).select("stem", "is_internal")


PO_SQL = """
  po as (select upper(po_number) as po_key, po_number, po_supplier_id, subtotal_cents + cast(floor(subtotal_cents/10.0+0.5) as bigint) as po_total_cents,
     s.name as po_supplier_name, n_lines from poh left join sup s on s.supplier_ord=poh.s_suppkey),
  lk as (select h.*, nullif(trim(po_ref),'') as wanted, po.po_key, po.po_supplier_id, po.po_total_cents, po.po_supplier_name, po.n_lines, po.po_number as found_number
     from hdr h left join po on po.po_key=upper(nullif(trim(po_ref),'')))"""


@query("po_lookup", with_views("hdr", "sup", "poh") + "," + PO_SQL + """
 select stem, coalesce(found_number, wanted) as po_number, po_key is not null as po_found, po_total_cents, po_supplier_name, po_supplier_id from lk""")
def po_lookup(spark, sf):
    j = O.lookup_orders(I.invoices(spark, sf).select("stem", "po_number"), I.purchase_orders(spark, sf))
    return j.select("stem", F.col("matched_po.po_number").alias("po_number"), "po_found",
                    F.floor(F.col("matched_po.po_total") * 100).cast(BIG).alias("po_total_cents"),
                    F.col("matched_po.po_supplier_name").alias("po_supplier_name"), F.col("matched_po.po_supplier_id").alias("po_supplier_id"))


# Candidate pairs and the greedy one-to-one assignment by stepping through the line index.
PAIRS = with_views("hdr", "sup", "poh", "lin", "pol") + "," + PO_SQL + """,
  pr as (select lk.ok, lk.stem, l.line_index, l.sku, l.description, l.qty, l.unit_cents, l.line_cents,
     p.line_number-1 as po_pos, p.line_number as po_line_number, p.sku as po_sku, p.description as po_description,
     p.qty as po_qty, p.unit_cents as po_unit_cents, p.qty*p.unit_cents as po_cents,
     coalesce(upper(l.sku)=upper(p.sku), false) as sku_equal
     from lk join lin l on l.ok=lk.ok join pol p on 'PO-' || lpad(cast(p.ok as varchar),8,'0') = lk.po_key),
  txt as (select d, """ + tsort_sql("d") + """ as t from (select distinct description as d from lin union select distinct description from pol)),
  pt as (select pr.*, x.t as a, y.t as b from pr join txt x on x.d=pr.description join txt y on y.d=pr.po_description),
  need as (select a, b from pt where not sku_equal and 200*least(length(a),length(b)) >= 65*(length(a)+length(b))),
""" + lcs_sql("need") + """,
  good as (select pt.*, case when sku_equal then 100.0::double else 200.0*lcs/(length(pt.a)+length(pt.b)) end as score
     from pt left join lcs_scored s on s.a=pt.a and s.b=pt.b and not sku_equal
     where sku_equal or 200*lcs >= 65*(length(pt.a)+length(pt.b)))"""


def greedy_sql(good: str = "good") -> str:
    return f""",
  step as (
    select stem, cast(-1 as bigint) as line_index, cast([] as bigint[]) as used, cast(null as bigint) as pick, cast(null as double) as pick_score from (select distinct stem from {good})
    union all
    select stem, line_index, case when pick is null then used else list_append(used, pick) end, pick, pick_score from (
      select s.stem, s.line_index+1 as line_index, s.used,
        (select arg_min(g.po_pos, (case when g.sku_equal then 0 else 1 end, -g.score, g.po_pos)) from {good} g
          where g.stem=s.stem and g.line_index=s.line_index+1 and not list_contains(s.used, g.po_pos)) as pick,
        (select arg_min(g.score, (case when g.sku_equal then 0 else 1 end, -g.score, g.po_pos)) from {good} g
          where g.stem=s.stem and g.line_index=s.line_index+1 and not list_contains(s.used, g.po_pos)) as pick_score
      from step s join (select stem as t, max(line_index) as last from {good} group by 1) m on m.t=s.stem where s.line_index < m.last)),
  chosen as (select stem, line_index, pick as po_pos, pick_score as score from step where pick is not null)"""


ASSIGN = PAIRS + greedy_sql()


def links(spark, sf):
    return O.lookup_orders(I.invoices(spark, sf).select("stem", "po_number"), I.purchase_orders(spark, sf))


@query("line_pairs_scored", PAIRS + " select stem, line_index, po_pos, sku_equal, score from good")
def line_pairs_scored(spark, sf):
    pairs = O.pair_lines(O.linked(links(spark, sf)), I.lines(spark, sf), I.po_lines(spark, sf))
    return O.score_pairs(pairs, I.PARAMS.line_fuzzy_threshold).select("stem", "line_index", "po_pos", "sku_equal", "score")


def line_found(spark, sf, method: str = "similarity"):
    return O.match_lines(links(spark, sf), I.lines(spark, sf), I.po_lines(spark, sf), I.PARAMS, method)


def chosen(spark, sf, method: str = "similarity"):
    return O.assigned(line_found(spark, sf, method))


@query("line_assignment", ASSIGN + " select stem, line_index, po_pos, score from chosen")
def line_assignment(spark, sf):
    return chosen(spark, sf).select("stem", "c.line_index", "c.po_pos", (-F.col("c.neg_score")).alias("score"))


@query("unmatched_invoice_lines", ASSIGN + """
 select l.stem, l.line_index from lin l join lk on lk.ok=l.ok where lk.po_key is not null
  and not exists (select 1 from chosen c where c.stem=l.stem and c.line_index=l.line_index)""")
def unmatched_invoice_lines(spark, sf):
    return O.unmatched_invoice_lines(links(spark, sf), I.lines(spark, sf), chosen(spark, sf))


@query("unmatched_po_lines", ASSIGN + """
 select lk.stem, p.line_number-1 as po_pos, p.line_number as po_line_number from lk join pol p on upper(p.po_number)=lk.po_key
 where not exists (select 1 from chosen c where c.stem=lk.stem and c.po_pos=p.line_number-1)""")
def unmatched_po_lines(spark, sf):
    return O.unmatched_po_lines(line_found(spark, sf))


FLAGS = ASSIGN + """,
  flags as (select l.stem, l.line_index, c.po_pos+1 as po_line_number, p.po_description, c.po_pos is not null as matched, l.description as invoice_description,
     case when c.po_pos is not null then abs(l.qty-p.po_qty)=0 end as quantity_matches,
     case when c.po_pos is not null then case when p.po_unit_cents=0 then l.unit_cents=0 else 100*abs(l.unit_cents-p.po_unit_cents) <= p.po_unit_cents end end as price_matches,
     case when c.po_pos is not null then abs(l.line_cents-p.po_cents) <= 5 end as total_matches,
     coalesce(floor(c.score*10+0.5)/1000, 0) as match_score, l.qty, l.unit_cents, p.po_qty, p.po_unit_cents
   from lin l join lk on lk.ok=l.ok left join chosen c on c.stem=l.stem and c.line_index=l.line_index
   left join (select distinct stem, po_pos, po_description, po_qty, po_unit_cents, po_cents from pr) p on p.stem=l.stem and p.po_pos=c.po_pos
   where lk.po_key is not null and lk.n_lines > 0)"""


@query("line_flags", FLAGS + """
 select stem, line_index, po_line_number, po_description, matched, quantity_matches, price_matches, total_matches, match_score from flags""")
def line_flags(spark, sf):
    m = O.line_matches(line_found(spark, sf))
    return m.select("stem", "line_index", "po_line_number", "po_description", "matched", "quantity_matches", "price_matches", "total_matches",
                    F.coalesce(F.floor(F.col("raw_score") * 10 + 0.5) / 1000, F.lit(0.0)).alias("match_score"))


SUBSTRING = with_views("hdr", "sup", "poh", "lin", "pol") + "," + PO_SQL + """,
  pr as (select lk.stem, l.line_index, l.description, p.line_number-1 as po_pos, p.description as po_description,
     coalesce(upper(l.sku)=upper(p.sku), false) as sku_equal
     from lk join lin l on l.ok=lk.ok join pol p on 'PO-' || lpad(cast(p.ok as varchar),8,'0') = lk.po_key),
  good as (select *, case when sku_equal then 100.0::double else 80.0::double end as score from pr
     where sku_equal or contains(lower(po_description), lower(description)) or contains(lower(description), lower(po_description)))"""


@query("line_substring_match", SUBSTRING + greedy_sql() + " select stem, line_index, po_pos, score from chosen")
def line_substring_match(spark, sf):
    return chosen(spark, sf, "substring").select("stem", "c.line_index", "c.po_pos", (-F.col("c.neg_score")).alias("score"))


# The same rule on documents with many lines: every customer's orders as one invoice against one order.
LARGE = with_views("clin", "cpol") + """,
  good as (select l.stem, l.line_index, p.po_pos, coalesce(upper(l.sku)=upper(p.sku), false) as sku_equal,
     case when coalesce(upper(l.sku)=upper(p.sku), false) then 100.0::double else 80.0::double end as score
     from clin l join cpol p on p.po_key=l.po_key
     where coalesce(upper(l.sku)=upper(p.sku), false) or contains(lower(p.description), lower(l.description)) or contains(lower(l.description), lower(p.description)))"""


def large(spark, sf, method: str):
    lines, stock = I.view(spark, sf, "clin"), I.view(spark, sf, "cpol")
    links_ = lines.select("stem", "po_key").distinct().withColumn("po_found", F.lit(True))
    money = lambda rows, total: rows.withColumns({"quantity": F.col("qty").cast(MONEY), "unit_price": I.cents("unit_cents"), "total": I.cents(total)})
    mine = money(lines, "line_cents").drop("po_key")
    theirs = money(stock.withColumn("line_cents", F.col("qty") * F.col("unit_cents")), "line_cents")
    theirs = theirs.withColumns({"line_number": (F.col("po_pos") + 1).cast("int"), "expected_quantity": F.col("quantity"), "expected_unit_price": F.col("unit_price")})
    return O.assign_lines(links_, mine, theirs, I.PARAMS, method).select("stem", "c.line_index", "c.po_pos", (-F.col("c.neg_score")).alias("score"))


@query("line_substring_large", LARGE + greedy_sql() + " select stem, line_index, po_pos, score from chosen")
def line_substring_large(spark, sf):
    return large(spark, sf, "substring")


@query("line_assignment_large")
def line_assignment_large(spark, sf):
    """Similar descriptions; SQL is too slow for the scores of whole tables, tests compare the operator with brute force."""
    return large(spark, sf, "similarity")


@query("computed_totals", with_views("lin") + """
 select stem, line_index, line_cents as total_cents, computed as total_computed from lin""")
def computed_totals(spark, sf):
    return I.lines(spark, sf).select("stem", "line_index", F.floor(F.col("total") * 100).cast(BIG).alias("total_cents"), "total_computed")
