"""Registered queries of the subpackage: SQL where there is some, and that each can be built and run on the smallest tables."""

from pathlib import Path

import pytest

from ledgerloom.llm.queries import ORACLES, QUERIES
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = {"op5_warc": "page_id", "op6_nearest": "query_id"}


@pytest.mark.skipif(not Path(SF).exists(), reason="given tables absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(name, spark, duck(SF), SF, QUERIES, ORACLES) is None
        return
    out = QUERIES[name](spark, SF)
    key = KEYS.get(name, "doc_id")
    documents = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()
    if name in ("pipeline", "op6_nearest", "op8_packing"):
        assert out.select(key).distinct().count() > 0
    else:
        assert out.count() == documents == out.select(key).distinct().count()
