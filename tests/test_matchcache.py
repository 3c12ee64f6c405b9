"""Kept matches: what a second run scores, and that the results are those of a run without a cache."""

import dataclasses

from ledgerloom.operators import suppliers as SUP
from ledgerloom.params import Params
from ledgerloom.sources.masters import supplier_master

NAMES = ["Acme Insight Sydney Pty Ltd", "River Marketing Perth Pty Ltd", "Global Freight Hobart Pty Ltd"]


def master(spark, names):
    empty = "acn string, email string, phone string, address string, aliases string"
    rows = [(i, f"S{i}", n, f"{i}1", *[""] * 5) for i, n in enumerate(names)]
    return supplier_master(spark.createDataFrame(rows, f"ord int, id string, name string, abn string, {empty}"))


def blocks(spark, names):
    rows = [(n, *[None] * 6) for n in names]
    supplier = "struct<name:string,abn:string,acn:string,address:string,email:string,phone:string,website:string>"
    return SUP.supplier_blocks(spark.createDataFrame([(r,) for r in rows], f"supplier {supplier}"))


def test_a_second_run_scores_only_new_names(spark, tmp_path, monkeypatch):
    scored, plain = [], SUP.fuzzy_best

    def recorded(keys, suppliers, threshold):
        scored.append(sorted(r.name_key for r in keys.collect()))
        return plain(keys, suppliers, threshold)

    monkeypatch.setattr(SUP, "fuzzy_best", recorded)
    kept = Params(match_cache=f"{tmp_path}/matches")
    none = dataclasses.replace(kept, match_cache=None)
    runs = [
        (NAMES, ["Acme Insght Sydney", "Nothing Alike", "River Marketing Prth"]),
        (NAMES, ["Acme Insght Sydney", "Nothing Alike", "Global Frieght Hobart"]),
        (NAMES, ["Nothing Alike"]),
        ([*NAMES, "Nothing Alike Here"], ["Nothing Alike", "Acme Insght Sydney"]),
    ]
    for names, asked in runs:
        got = SUP.resolve_blocks(blocks(spark, asked), master(spark, names), kept).select("name", "matched_supplier.supplier_id", "matched_supplier.confidence").collect()
        counted = len(scored)
        want = SUP.resolve_blocks(blocks(spark, asked), master(spark, names), none).select("name", "matched_supplier.supplier_id", "matched_supplier.confidence").collect()
        del scored[counted:]
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert [len(s) for s in scored] == [3, 1, 0, 2]
