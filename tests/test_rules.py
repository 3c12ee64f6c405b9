"""Header findings: what is computed, and how."""

from catalogue.inputs import AS_OF
from ledgerloom.operators import rules
from ledgerloom.params import Params

SCHEMA = """stem string, invoice_number string, invoice_date string, due_date string,
 supplier struct<name:string,abn:string,acn:string>, po_number string, subtotal decimal(18,4), tax_rate double, tax_amount decimal(18,4),
 shipping decimal(18,4), other_charges decimal(18,4), total decimal(18,4), custom_fields map<string,string>,
 matched_supplier struct<supplier_id:string>, is_internal boolean, po_found boolean, po_key string,
 matched_po struct<po_number:string,po_total:decimal(18,4),po_supplier_name:string,po_supplier_id:string>,
 n_lines long, n_totals long, lines_total decimal(28,4)"""


def findings(spark):
    from decimal import Decimal as D

    good = ("a", "N1", "1998-06-01", "1998-07-01", ("S", None, None), None, D(100), 0.1, D(10), None, None, D(110), {}, ("SUP-1",), False, False, None, None, 1, 1, D(100))
    bare = ("b", None, None, None, None, None, None, None, None, None, None, None, {}, None, None, None, None, None, None, None, None)
    return rules.header_findings(spark.createDataFrame([good, bare], SCHEMA), Params(as_of=AS_OF))


def test_findings_of_a_good_and_a_bare_invoice(spark):
    out = {r.stem: [f.rule for f in r.findings] for r in findings(spark).collect()}
    assert out == {"a": [], "b": ["F1"] * 4 + ["F2", "F3", "F4", "F5", "F8"]}


def test_rules_do_not_stand_under_a_lambda(spark):
    """What stands under a lambda is interpreted: of the rules only the mandatory fields may."""
    df = findings(spark).select("findings")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    under = plan[plan.index("filter(") : plan.index("lambda")]
    assert "mandatory_field_missing" in under and "po_total_exceeded" not in under
    assert df.schema["findings"].dataType.simpleString() == rules._FINDINGS
