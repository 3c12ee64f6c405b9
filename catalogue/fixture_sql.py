"""Input views as SQL that runs unchanged in Spark and DuckDB, derived from the given tables.

Keys decide every perturbation, so the same rows come out of both engines at any scale.
"""

CTE = {}

CTE["sup"] = """
 select s_suppkey as supplier_ord, ('SUP-' || cast(s_suppkey as string)) as supplier_id,
  (split_part('Acme,River,Global,North,Summit,Harbour,Coastal,Metro,Pioneer,Union',',',cast(s_suppkey%10+1 as int)) || ' '
   || split_part('Insight,Marketing,Logistics,Supplies,Systems,Freight,Energy,Print,Security,Catering',',',cast(floor(s_suppkey/10)%10+1 as int)) || ' '
   || split_part('Sydney,Perth,Hobart,Cairns,Darwin,Geelong,Albury,Dubbo,Mackay,Ballarat',',',cast(floor(s_suppkey/100)%10+1 as int))
   || case when s_suppkey >= 1000 then (' Branch ' || cast(cast(floor(s_suppkey/1000) as int) as string)) else '' end || ' Pty Ltd') as name,
  cast(10000000000+s_suppkey*7919 as string) as abn,
  ('accounts@sup' || cast(s_suppkey as string) || '.example.com') as email,
  ('Trader ' || cast(s_suppkey as string) || '|' || 'TR' || cast(s_suppkey as string)) as aliases
 from supplier"""

CTE["pol"] = """
 select o.o_orderkey as ok, ('PO-' || lpad(cast(o.o_orderkey as string),8,'0')) as po_number,
  row_number() over (partition by o.o_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) as line_number,
  ('P' || cast(l_partkey as string)) as sku, (p_name || ' ' || p_brand || ' ' || lower(p_type)) as description,
  l_suppkey, cast(floor(l_quantity+0.5) as bigint) as qty,
  cast(floor(l_extendedprice*100/l_quantity+0.5) as bigint) as unit_cents
 from orders o join lineitem on l_orderkey=o.o_orderkey join part on p_partkey=l_partkey"""

CTE["poh"] = """
 select g.*, case when ok%50=3 then null when ok%50=13 then 'SUP-0' else ('SUP-' || cast(s_suppkey as string)) end as po_supplier_id
 from (select o.o_orderkey as ok, ('PO-' || lpad(cast(o.o_orderkey as string),8,'0')) as po_number,
  min(o.o_orderdate) as o_orderdate,
  min(case when line_number=1 then l_suppkey end) as s_suppkey, cast(coalesce(sum(qty*unit_cents),0) as bigint) as subtotal_cents,
  count(pol.ok) as n_lines
 from orders o left join pol on pol.ok=o.o_orderkey group by o.o_orderkey) g"""

CTE["inv"] = """
 select p.ok, ('inv_' || cast(p.ok as string)) as stem, p.ok%12 as variant, s.supplier_id as true_supplier, s.name as true_name,
  case p.ok%12 when 0 then 'Billing Office' when 1 then upper(s.name) when 2 then ('Trader ' || cast(p.s_suppkey as string))
   when 3 then ('Pty Ltd ' || replace(s.name,' Pty Ltd','')) when 4 then replace(s.name,'i','') when 5 then 'Zzyzx Quux Vendor'
   when 6 then 'Zzyzx Quux Vendor' when 7 then null when 8 then 'Billing Office' when 9 then 'Moyaware' when 10 then '' else s.name end as inv_name,
  case when p.ok%12=0 then (substr(s.abn,1,2) || ' ' || substr(s.abn,3,3) || ' ' || substr(s.abn,6,3) || ' ' || substr(s.abn,9,3)) when p.ok%12=9 then '22 234 567 789' end as inv_abn,
  case when p.ok%12=8 then s.abn end as inv_acn,
  case when p.ok%12 in (5,10) then replace(s.email,'accounts@','Billing@') end as inv_email,
  case when p.ok%5=0 then null when p.ok%5=1 then (' ' || lower(p.po_number) || ' ') when p.ok%35=2 then 'PO-MISSING' else p.po_number end as po_ref,
  p.po_number, p.o_orderdate, p.subtotal_cents
 from poh p left join sup s on s.supplier_ord=p.s_suppkey"""

CTE["il"] = """
 select ok, ('inv_' || cast(ok as string)) as stem,
  cast(case when ok%13=5 and line_number>2 then line_number-2 else line_number-1 end as bigint) as line_index,
  case when line_number%3=0 or (ok%7 in (3,4) and line_number=1 and ok%2=0) then null else sku end as sku,
  case when ok%7=3 and line_number=1 then (split_part(description,' ',2) || ' ' || split_part(description,' ',1) || ' ' || split_part(description,' ',4) || ' ' || split_part(description,' ',3))
       when ok%7=4 and line_number=1 then 'unplanned surcharge' else description end as description,
  case when ok%11=1 and line_number=1 then qty+1 else qty end as qty,
  cast(case when ok%11=2 and line_number=1 then floor(unit_cents*105/100) else unit_cents end as bigint) as unit_cents
 from pol where not (ok%13=5 and line_number=2)"""

# Lines with the total as printed (raw, may be null or negative) and after computed totals.
CTE["lin"] = """
 select *, coalesce(raw_cents, qty*unit_cents) as line_cents, raw_cents is null as computed from (
  select il.*, case when (ok+line_index)%9=0 then null when ok%37=0 and line_index=0 then -(qty*unit_cents) else qty*unit_cents end as raw_cents
  from il)"""

CTE["isum"] = """
 select ok, cast(sum(qty*unit_cents) as bigint) as base_cents from il group by ok"""

CTE["hdr"] = """
 select ok, stem, variant, true_supplier, true_name, inv_name, inv_abn, inv_acn, inv_email, po_ref, po_number, invoice_number,
  case ok%4 when 0 then iso when 1 then (substr(iso,9,2) || '/' || substr(iso,6,2) || '/' || substr(iso,1,4))
            when 2 then (substr(iso,9,2) || '-' || substr(iso,6,2) || '-' || substr(iso,1,4))
            else (substr(iso,1,4) || '/' || substr(iso,6,2) || '/' || substr(iso,9,2)) end as good_date,
  case when ok%31=0 then 'not a date' when ok%31=1 then null
       else case ok%4 when 0 then iso when 1 then (substr(iso,9,2) || '/' || substr(iso,6,2) || '/' || substr(iso,1,4))
            when 2 then (substr(iso,9,2) || '-' || substr(iso,6,2) || '-' || substr(iso,1,4))
            else (substr(iso,1,4) || '/' || substr(iso,6,2) || '/' || substr(iso,9,2)) end end as invoice_date,
  due as due_date, iso,
  base + case when ok%23=1 then 1000 else 0 end as subtotal_cents,
  cast(floor(base/10.0+0.5) as bigint) + case when ok%23=2 then 700 else 0 end as tax_cents,
  case when ok%23=4 then null when ok%23=5 then 0 when ok%23=6 then -(base + cast(floor(base/10.0+0.5) as bigint))
       else base + cast(floor(base/10.0+0.5) as bigint) + case when ok%23=3 then 5000 else 0 end end as total_cents
 from (
  select inv.*, coalesce(base_cents,0) as base, cast(cast(o_orderdate as date) as string) as iso,
   case when inv.ok%29=0 then null when inv.ok%29=1 then '' else ('INV-' || cast(inv.ok as string)) end as invoice_number,
   case when inv.ok%19=0 then null else cast(cast(o_orderdate as date) + case when inv.ok%17=0 then -5 else 30 end as string) end as due
  from inv left join isum on isum.ok=inv.ok)"""

# Order headers and lines as text rows with repeated numbers and orphans (ord = file position).
CTE["po_rows"] = """
 select ok*2 as ord, (case when ok%6=1 then (' ' || lower(po_number) || ' ') else po_number end) as po_number,
  coalesce(po_supplier_id,'') as supplier_id, ok, subtotal_cents,
  cast(subtotal_cents + floor(subtotal_cents/10.0+0.5) as bigint) as total_cents, s_suppkey
 from poh
 union all
 select ok*2+1 as ord, po_number, ('SUP-' || cast(s_suppkey as string)), ok, subtotal_cents+100,
  cast(subtotal_cents + floor(subtotal_cents/10.0+0.5) + 100 as bigint), s_suppkey
 from poh where ok%40=7"""

CTE["pol_rows"] = """
 select ok*1000+line_number as ord, case when ok%25=4 then ('XX-' || po_number) when ok%3=1 then (' ' || lower(po_number)) else po_number end as po_number,
  case when line_number%4=0 then null else line_number end as line_number, sku, description, qty, unit_cents, ok
 from pol"""

# Event log rows: every table event becomes one operation on an invoice.
CTE["log"] = """
 select ('inv_' || cast(user_id as string)) as stem, event_id as seq, ts, value, props,
  case event_type when 'purchase' then 'processed' when 'error' then 'failed' when 'signup' then 'status_changed'
   when 'click' then 'corrections_saved'
   else case event_id%10 when 0 then 'deleted' when 1 then 'reset' when 2 then 'reevaluated' else 'notes_updated' end end as op,
  case event_type when 'signup' then case event_id%5 when 0 then 'needs_review' when 1 then 'exported' when 2 then 'bogus' else 'ready' end
   when 'purchase' then case when event_id%3=0 then 'needs_review' else 'ready' end
   when 'view' then case when event_id%4=2 then 'needs_review' else 'ready' end end as new_status,
  event_id%3 as n_err, event_id%4 as n_warn, cast(floor(value*100+0.5) as bigint) as cents,
  ('Supplier ' || cast(user_id%40 as string)) as supplier_name, ('INV-' || cast(event_id as string)) as invoice_number,
  case when event_id%7=0 then 'operator' else 'system' end as actor
 from events"""

# All orders of a customer as one document: invoices and orders with many lines.
CTE["clin"] = """
 select ('cust_' || cast(o_custkey as string)) as stem, ('CUST-' || cast(o_custkey as string)) as po_key,
  cast(row_number() over (partition by o_custkey order by lin.ok, line_index) - 1 as bigint) as line_index, sku, description, qty, unit_cents, line_cents
 from lin join orders on o_orderkey=lin.ok"""

CTE["cpol"] = """
 select ('CUST-' || cast(o_custkey as string)) as po_key,
  cast(row_number() over (partition by o_custkey order by pol.ok, line_number) - 1 as bigint) as po_pos, sku, description, qty, unit_cents
 from pol join orders on o_orderkey=pol.ok"""

DEPENDS = {
    "clin": ["lin"], "cpol": ["pol"],
    "sup": [], "pol": [], "poh": ["pol"], "inv": ["poh", "sup"], "il": ["pol"], "lin": ["il"], "isum": ["il"],
    "hdr": ["inv", "isum"], "po_rows": ["poh"], "pol_rows": ["pol"], "log": [],
}
BASE = {
    "clin": ["orders"], "cpol": ["orders"], "sup": ["supplier"], "pol": ["orders", "lineitem", "part"], "poh": ["orders"], "log": ["events"],
}


def closure(names: list[str], stored: tuple[str, ...] = ()) -> list[str]:
    """CTE names needed for ``names``, dependencies first; those of ``stored`` need none."""
    out: list[str] = []

    def visit(n: str) -> None:
        for d in () if n in stored else DEPENDS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(*names: str) -> str:
    """``with ... `` prefix for DuckDB oracles; oracle text continues with ``, more as (...)`` or ``select``."""
    return "with recursive " + ",\n".join(f"{n} as ({CTE[n]})" for n in closure(list(names)))
