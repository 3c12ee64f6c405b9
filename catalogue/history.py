"""Queries and oracles: event log, review state, lists, statistics, audit and file discovery."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.fixture_sql import with_views
from ledgerloom.operators import state as ST
from ledgerloom.operators import views as V
from ledgerloom.operators.store import EventStore
from ledgerloom.session import shared_dir
from ledgerloom.sources import landing as L

QUERIES, ORACLES = {}, {}
NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
NOW_SQL = "timestamp '2024-01-31 00:00:00'"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def events(spark, sf):
    log = I.view(spark, sf, "log")
    return ST.as_events(
        log.select(
            "stem", "seq", "ts", "op", "actor", F.col("new_status").alias("status"), F.concat("stem", F.lit(".pdf")).alias("source_file"),
            (F.col("seq") % 1000 + F.lit(0.25)).alias("source_mtime"), "invoice_number", "supplier_name",
            F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Matched "), "supplier_name")).alias("matched_supplier"),
            I.cents("cents").alias("total"), F.lit("AUD").alias("currency"), F.col("n_err").alias("error_count"),
            F.col("n_warn").alias("warning_count"), (F.col("n_err") + F.col("n_warn")).alias("discrepancy_count"),
            F.when(F.col("op") == "corrections_saved", F.col("props")).alias("corrections"),
            F.when(F.col("op") == "notes_updated", F.concat(F.lit("note "), F.col("seq").cast("string"))).alias("notes"),
            F.col("props").alias("detail"),
        )
    )


def state(spark, sf):
    return I._once(spark, sf, "state", lambda: ST.fold(events(spark, sf)))


LOG = with_views("log")
STATE = LOG + """,
  ok_events as (select * from log where op <> 'status_changed' or new_status in ('needs_review','ready','exported')),
  ranked as (select *, row_number() over (partition by stem order by ts, seq) as n from ok_events),
  dels as (select stem, max(n) as gone from ranked where op='deleted' group by 1),
  live as (select r.* from ranked r left join dels d using (stem) where d.gone is null or r.n > d.gone),
  starts as (select stem, min(n) as start_n from live where op in ('processed','failed') group by 1),
  ev as (select l.* from live l join starts s using (stem) where l.n >= s.start_n),
  state as (select stem,
    stem || '.pdf' as source_file,
    arg_max(case when op in ('failed','reset') then 'needs_review' else new_status end, n)
      filter (op in ('processed','failed','status_changed','reset') or (op='reevaluated' and new_status='needs_review')) as status,
    arg_max(invoice_number, n) filter (op='processed') as invoice_number,
    arg_max(supplier_name, n) filter (op='processed') as supplier_name,
    nullif(arg_max(case when seq%2=0 then 'Matched ' || supplier_name else '#' end, n) filter (op in ('processed','reevaluated')),'#') as matched_supplier,
    arg_max(cents, n) filter (op='processed') as total_cents,
    coalesce(arg_max(case when op='failed' then 1 else n_err end, n) filter (op in ('processed','failed','reevaluated')),0) as error_count,
    coalesce(arg_max(n_warn, n) filter (op in ('processed','reevaluated')),0) as warning_count,
    coalesce(arg_max(n_warn+n_err, n) filter (op in ('processed','reevaluated')),0) as discrepancy_count,
    nullif(arg_max(case when op='corrections_saved' then props else '#' end, n) filter (op in ('corrections_saved','processed','failed','reset')),'#') as corrections,
    nullif(arg_max(case when op='notes_updated' then 'note ' || seq else '#' end, n) filter (op in ('notes_updated','processed')),'#') as notes,
    nullif(arg_max(case when op='status_changed' then ts else timestamp '1900-01-01' end, n)
      filter (op in ('processed','reset') or (op='status_changed' and new_status='exported')), timestamp '1900-01-01') as exported_at,
    arg_max(ts, n) filter (op in ('processed','failed')) as processed_at,
    coalesce(arg_max(case when op='reset' then 0.0::double else seq%1000+0.25::double end, n) filter (op in ('processed','failed','reset')),0) as source_mtime
    from ev group by stem)"""
STATE_OUT = "stem, status, invoice_number, supplier_name, matched_supplier, total_cents, cast(error_count as bigint) as error_count, cast(warning_count as bigint) as warning_count, corrections, notes, cast(exported_at as varchar) as exported_at, cast(processed_at as varchar) as processed_at, source_mtime"


def ts_text(c: str):
    return F.col(c).cast("string").alias(c)


def total_cents():
    return F.floor(F.col("total") * 100).cast("bigint").alias("total_cents")


def state_out(df):
    return df.select("stem", "status", "invoice_number", "supplier_name", "matched_supplier", total_cents(), "error_count", "warning_count",
                     "corrections", "notes", ts_text("exported_at"), ts_text("processed_at"), "source_mtime")


@query("state_latest", STATE + f" select {STATE_OUT} from state")
def state_latest(spark, sf):
    return state_out(ST.fold(events(spark, sf)))


@query("state_from_snapshot", STATE + f" select {STATE_OUT} from state")
def state_from_snapshot(spark, sf):
    """Compaction: the older half folded to a snapshot, then folded again with the newer half."""
    ev = events(spark, sf)
    cut = F.lit(dt.datetime(2024, 1, 15))
    snapshot = ST.snapshot_events(ST.fold(ev.filter(F.col("ts") < cut)))
    return state_out(ST.fold(snapshot.unionByName(ev.filter(F.col("ts") >= cut))))


@query("state_compacted", STATE + f" select {STATE_OUT} from state")
def state_compacted(spark, sf):
    """The log appended in four runs to a store that is compacted after the first and the third: its state is that of the whole log."""
    store = EventStore(f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", rows_per_bucket=200)
    cuts = [dt.datetime(2024, 1, d) for d in (1, 9, 16, 24)] + [dt.datetime(2025, 1, 1)]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        day = dt.datetime(2024, 2, 1 + i, tzinfo=dt.timezone.utc)
        part = events(spark, sf).filter((F.col("ts") < high) & ((F.col("ts") >= low) | F.lit(i == 0)))
        store.append(part, f"run-{i}", store.begin(spark, f"run-{i}", day))
        if i in (0, 2):
            store.compact(spark, day.date())
    return state_out(store.state(spark))


@query("status_transitions", LOG + """
 select op, new_status as status, op <> 'status_changed' or coalesce(new_status in ('needs_review','ready','exported'),false) as accepted, count(*) as n
 from log group by 1,2,3""")
def status_transitions(spark, sf):
    ev = events(spark, sf)
    return ev.groupBy("op", "status", ST.valid_status(ev).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("rejected_status", LOG + " select stem, seq, new_status as status from log where op='status_changed' and not coalesce(new_status in ('needs_review','ready','exported'),false)")
def rejected_status(spark, sf):
    return ST.rejected(events(spark, sf)).select("stem", "seq", "status")


@query("change_requests", STATE + """
 , req as (select distinct stem from log union all select 'inv_x' || s_suppkey from supplier)
 select r.stem, coalesce(s.status,'') <> '' and s.status <> 'exported' as accepted from req r left join state s using (stem)""")
def change_requests(spark, sf):
    st = state(spark, sf)
    req = I.view(spark, sf, "log").select("stem").distinct().unionByName(
        I.base(spark, sf, "supplier").select(F.concat(F.lit("inv_x"), F.col("s_suppkey").cast("string")).alias("stem"))
    )
    good, bad = ST.accept_changes(req, st)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query("audit_append", LOG + """
 select seq as id, stem, cast(ts as varchar) as timestamp, case when op='failed' then 'processing_failed' when op='status_changed' and new_status='exported' then 'exported' else op end as action,
  actor, props as detail from log""")
def audit_append(spark, sf):
    return ST.audit_log(events(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("string"))


@query("list_by_status", STATE + f" select {STATE_OUT} from state where status='ready'")
def list_by_status(spark, sf):
    return state_out(V.by_status(state(spark, sf), "ready"))


@query("list_search", STATE + """
 select stem, supplier_name, matched_supplier from state where coalesce(invoice_number ilike '%PLIER 1%',false) or coalesce(supplier_name ilike '%PLIER 1%',false) or coalesce(matched_supplier ilike '%PLIER 1%',false)""")
def list_search(spark, sf):
    return V.search(state(spark, sf), "PLIER 1").select("stem", "supplier_name", "matched_supplier")


@query("list_search_literal", STATE + """
 select stem, invoice_number from state where contains(lower(coalesce(invoice_number,'')),'v-') or contains(lower(coalesce(supplier_name,'')),'v-') or contains(lower(coalesce(matched_supplier,'')),'v-')""")
def list_search_literal(spark, sf):
    return V.search(state(spark, sf), "V-", literal=True).select("stem", "invoice_number")


@query("list_window", STATE + f"""
 , w as (select 'today' as w, {NOW_SQL} as lo union all select 'last7', {NOW_SQL} - interval 7 day union all select 'last30', {NOW_SQL} - interval 30 day
   union all select 'this_year', timestamp '2024-01-01' union all select 'today+600', timestamp '2024-01-30 10:00:00' union all select 'all', null)
 select w as window_name, stem, cast(processed_at as varchar) as processed_at from state, w where lo is null or processed_at >= lo""")
def list_window(spark, sf):
    st = state(spark, sf)
    cases = [("today", 0), ("last7", 0), ("last30", 0), ("this_year", 0), ("today", 600), ("all", 0)]
    # One scan: each row lists the windows it falls in.
    hits = F.array(*[
        F.when(V.in_window(w, NOW, off), F.lit(w if not off else f"{w}+{off}")) for w, off in cases
    ])
    return st.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("window_name"), "stem", ts_text("processed_at"))


@query("list_page", STATE + """
 select stem, cast(processed_at as varchar) as processed_at, status from state order by processed_at desc, stem limit 20 offset 10""")
def list_page(spark, sf):
    return V.list_invoices(state(spark, sf), NOW, limit=20, offset=10).select("stem", ts_text("processed_at"), "status")


@query("list_page_after", STATE + """
 select stem, cast(processed_at as varchar) as processed_at from state where processed_at < timestamp '2024-01-29 00:00:00' order by processed_at desc, stem limit 25""")
def list_page_after(spark, sf):
    return V.page_after(state(spark, sf), dt.datetime(2024, 1, 29), "zzz", 25).select("stem", ts_text("processed_at"))


@query("list_summary", STATE + """
 select stem, source_file, status, invoice_number, supplier_name, total_cents, 'AUD' as currency, cast(discrepancy_count as bigint) as discrepancy_count, notes
 from state where invoice_number is not null""")
def list_summary(spark, sf):
    s = V.summary_columns(state(spark, sf)).filter("invoice_number is not null")
    return s.select("stem", "source_file", "status", "invoice_number", "supplier_name", total_cents(), "currency", "discrepancy_count", "notes")


@query("stats", STATE + f"""
 select count_if(i) as total, cast(sum(case when i then case when status='needs_review' then 1 else 0 end end) as bigint) as needs_review,
  cast(sum(case when i then case when status='ready' then 1 else 0 end end) as bigint) as ready, cast(sum(case when i then case when status='exported' then 1 else 0 end end) as bigint) as exported,
  cast(sum(case when i then error_count end) as bigint) as total_errors, cast(sum(case when i then warning_count end) as bigint) as total_warnings,
  cast(max(case when i then processed_at end) as varchar) as last_processed, count(*) as total_unfiltered
 from (select *, processed_at >= {NOW_SQL} - interval 7 day as i from state)""")
def stats(spark, sf):
    return V.stats(state(spark, sf), NOW, "last7").withColumn("last_processed", F.col("last_processed").cast("string"))


@query("invoice_detail", STATE + """
 , payload as (select stem, arg_max(invoice_number, n) as invoice_number, arg_max(cents, n) as total_cents, max(n) as n from ev where op='processed' group by 1)
 select p.stem, p.invoice_number, p.total_cents, s.status, s.corrections, s.notes, cast(s.exported_at as varchar) as exported_at, cast(s.processed_at as varchar) as processed_at
 from payload p join state s using (stem)""")
def invoice_detail(spark, sf):
    st = state(spark, sf)
    ev = events(spark, sf).filter("op = 'processed'")
    payload = (
        ev.groupBy("stem").agg(F.max(F.struct("ts", "seq", "invoice_number", "total")).alias("p"))
        .select("stem", F.col("p.invoice_number").alias("invoice_number"), F.col("p.total").alias("total"), F.col("p.ts").alias("processed_at"), F.lit("x").alias("status"))
        .join(st.filter("invoice_number is not null").select("stem"), "stem", "left_semi")
    )
    return V.detail(payload, st).select("stem", "invoice_number", total_cents(), "status", "corrections", "notes", ts_text("exported_at"), ts_text("processed_at"))


AUDIT_OUT = "seq as id, cast(ts as varchar) as timestamp, case when op='failed' then 'processing_failed' when op='status_changed' and new_status='exported' then 'exported' else op end as action, actor, props as detail"


@query("audit_trail", LOG + f" select {AUDIT_OUT} from log where stem='inv_7'")
def audit_trail(spark, sf):
    return V.audit_trail(ST.audit_log(events(spark, sf)), "inv_7").select("id", ts_text("timestamp"), "action", "actor", "detail")


@query("audit_recent", LOG + f" select stem, {AUDIT_OUT} from log order by ts desc, seq desc limit 200 offset 50")
def audit_recent(spark, sf):
    return V.audit_recent(ST.audit_log(events(spark, sf)), 200, 50).select("stem", "id", ts_text("timestamp"), "action", "actor", "detail")


FILES = STATE + """,
  files as (select 'inv_' || c_custkey as stem, '/landing/inv_' || c_custkey || '.pdf' as path,
     coalesce((select source_mtime from state s where s.stem='inv_' || c_custkey), 5.0) + case c_custkey%4 when 0 then 0 when 1 then 0.25 when 2 then 0.5 else -30 end as mtime from customer)"""


def files(spark, sf):
    """A landing folder listing: one file per customer, some touched since they were processed."""
    k = F.col("c_custkey")
    names = I.base(spark, sf, "customer").select(F.concat(F.lit("inv_"), k.cast("string")).alias("stem"), "c_custkey")
    shift = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.25).when(k % 4 == 2, 0.5).otherwise(-30.0)
    seen = state(spark, sf).select("stem", "source_mtime")
    return names.join(seen, "stem", "left").select(
        "stem", F.concat(F.lit("/landing/"), "stem", F.lit(".pdf")).alias("path"), (F.coalesce("source_mtime", F.lit(5.0)) + shift).alias("mtime")
    )


@query("pending_files", FILES + """
 select f.stem, f.path, cast(f.mtime as double) as mtime, s.stem is not null as is_reprocess from files f left join state s on s.stem=f.stem
 where s.stem is null or abs(s.source_mtime-f.mtime) >= 0.5""")
def pending_files(spark, sf):
    return L.pending(files(spark, sf), state(spark, sf)).select("stem", "path", "mtime", "is_reprocess")


@query("reprocess_changed", FILES + """
 select f.stem, cast(f.mtime as double) as mtime from files f join state s on s.stem=f.stem where abs(s.source_mtime-f.mtime) >= 0.5""")
def reprocess_changed(spark, sf):
    return L.pending(files(spark, sf), state(spark, sf)).filter("is_reprocess").select("stem", "mtime")


@query("queue_length", FILES + """
 select count_if(s.stem is null or abs(s.source_mtime-f.mtime) >= 0.5) as queue_length, count_if(abs(s.source_mtime-f.mtime) >= 0.5) as changed,
  count_if(s.stem is not null and abs(s.source_mtime-f.mtime) < 0.5) as skipped from files f left join state s on s.stem=f.stem""")
def queue_length(spark, sf):
    return L.queue_counts(files(spark, sf), state(spark, sf))


@query("duplicate_stems", LOG + " select stem, count(*) as n from log where op='processed' group by 1 having count(*) > 1")
def duplicate_stems(spark, sf):
    return L.duplicate_stems(events(spark, sf).filter("op = 'processed'"))
