"""What a trigger of the stream writes, and how the registered queries land documents."""

import gzip
import json
from pathlib import Path

from ledgerloom.params import Params
from ledgerloom.plans.reconcile import Masters
from ledgerloom.sources import masters as M
from ledgerloom.streaming import watch

ROWS = {
    "suppliers": ([(0, "S1", "Acme Pty Ltd", "", "", "", "", "", "")], ("ord", "id", "name", "abn", "acn", "email", "phone", "address", "aliases")),
}


def masters(spark):
    rows, names = ROWS["suppliers"]
    suppliers = M.supplier_master(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'ord' else 'string'}" for n in names)))
    money = "decimal(18,4)"
    orders = spark.createDataFrame([], f"po_key string, po_number string, supplier_id string, supplier_name string, subtotal {money}, tax_amount {money}, total {money}, currency string")
    lines = spark.createDataFrame([], "po_key string, po_pos long, line_number int, sku string, description string, " + ", ".join(
        f"{c} {money}" for c in ("quantity", "unit_price", "total", "expected_quantity", "expected_unit_price")) + ", unit string")
    return Masters(suppliers, orders, lines, spark.createDataFrame([], "id string, name string, abn string"))


def test_a_trigger_writes_no_copy_of_the_responses(spark, tmp_path, monkeypatch):
    tables = {}

    def noted(df, label):
        tables[label] = df.columns
        return real(df, label)

    real = watch.materialise
    monkeypatch.setattr(watch, "materialise", noted)
    old, new = (json.dumps({"invoice_number": n, "line_items": [{"quantity": 2, "unit_price": 3}]}) for n in ("OLD", "NEW"))
    docs = [("x", "/x", 1.0, old), ("x", "/x", 2.0, new), ("y", "/y", 1.0, "no json"), ("z", "/z", 1.0, new)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("stem", "path", "mtime", "response"), d))) for d in docs))
    w = watch.Watcher(f"{tmp_path}/log", lambda s: m, Params())
    m = masters(spark)
    watch.start(spark, f"{tmp_path}/in", w, f"{tmp_path}/ck").awaitTermination()
    assert not [label for label, columns in tables.items() if "response" in columns]
    rows = {r.stem: (r.invoice_number, r.source_mtime, r.op) for r in w.log(spark).collect()}
    assert rows == {"x": ("NEW", 2.0, "processed"), "y": (None, 1.0, "failed"), "z": ("NEW", 1.0, "processed")}
    # what is known already is not processed again
    (tmp_path / "in" / "b.json").write_text(json.dumps(dict(zip(("stem", "path", "mtime", "response"), docs[3]))))
    watch.start(spark, f"{tmp_path}/in", w, f"{tmp_path}/ck").awaitTermination()
    assert w.log(spark).count() == 3


def test_documents_land_compressed(spark, tmp_path):
    from catalogue.incremental import land

    land(spark.range(30).selectExpr("id as ok", "concat('s', id) as stem", "'r' as response"), f"{tmp_path}/in")
    files = list(Path(f"{tmp_path}/in").glob("part-*.json.gz"))
    lines = [line for f in files for line in gzip.open(f, "rt")]
    assert len(lines) == 30 and spark.read.json(f"{tmp_path}/in").count() == 30
