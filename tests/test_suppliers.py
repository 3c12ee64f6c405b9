"""Names equal to a master name after their words are sorted never enter the similarity join."""

from ledgerloom.operators import suppliers as SUP


def test_equal_names_stay_out_of_the_similarity_join(spark, monkeypatch):
    master = spark.createDataFrame(
        [(3, "S3", "Acme Freight Pty Ltd", ["Trader"]), (1, "S1", "Pty Ltd Acme Freight", None), (2, "S2", "River Print", None)],
        "supplier_ord long, supplier_id string, name string, aliases array<string>")
    keys = spark.createDataFrame([("pty ltd freight acme",), ("rver prnt",), ("zzz",)], "name_key string")
    asked, join = [], SUP.similar_pairs

    def spy(left, *rest, **more):
        asked.extend(r.probe for r in left.collect())
        return join(left, *rest, **more)

    monkeypatch.setattr(SUP, "similar_pairs", spy)
    got = {r.name_key: (r.supplier_ord, round(r.score, 2)) for r in SUP.fuzzy_best(keys, master, 75).collect()}
    assert sorted(asked) == ["prnt rver", "zzz"]
    assert got == {"pty ltd freight acme": (1, 100.0), "rver prnt": (2, 90.0)}
