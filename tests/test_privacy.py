"""Shapes, masks, redaction, and that summaries hold no raw value."""

import json

import pytest
from pyspark.sql import functions as F

from tablesense.functions.privacy import mask_value, message_template, redact_text, structural_pattern
from tablesense.operators import meaning, profile
from tablesense.plans import fk_discovery
from tablesense.plans.table_profile import profile_estate


def apply(make, fn, values):
    df = make([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "value, pattern",
    [
        ("SKU-ABX-001", "AAA-AAA-999"), ("jane.doe@mail.example", "email"), ("  ", "empty"),
        ("2024-01-31", "date"), ("2024-01-31 10:20:30", "date"), ("2024-01-31x", "9999-99-99A"),
        ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("abcdefgh", "A{8}"), ("abcd", "AAAA"),
        ("ABCDEFG-12345 x", "A{7}-9{5} A"), ("-----", "-{5}"), ("éü ß٣", "AA A9"), ("x²", "A9"),
        ("a\n\n\n\n\n\nb", "A\n\n\n\n\n\nA"), ("a.....b", "A.{5}A"), ("  ab  ", "AA"), ("Z" * 6, "A{6}"),
    ],
)
def test_structural_pattern(make, value, pattern):
    assert apply(make, structural_pattern, [value]) == [pattern]


def test_masks(make):
    values = ["carmen.i@mail.example", "ab", "a", "", "Secret", " x@y.zz ", "a@b.c.example", "abc"]
    assert apply(make, mask_value, values) == [
        "c***@m***.example", "**", "*", "", "S****t", "*@*.zz", "*@b***.example", "a*c",
    ]


def test_long_texts_are_shaped_whole(make):
    text = ("word " * 3000) + "longer " + ("ab1 " * 3000)
    shaped = apply(make, structural_pattern, [text])[0]
    assert shaped == ("AAAA " * 3000) + "A{6} " + ("AA9 " * 3000).rstrip()


def test_redaction(make):
    values = [
        "mail jane@corp.example about 4111 1111 1111 1111", "ORA-00600 at line 42", None,
        "a@b.ro x@host.com yy@z.net", "tel +40-21-555-0101!",
    ]
    assert apply(make, redact_text, values) == [
        "mail j***@c***.example about <number>", "ORA-00600 at line 42", "",
        "*@*.ro *@h***.com y***@*.net", "tel +<number>!",
    ]


def test_templates_level_numbers_and_space(make):
    assert len(set(apply(make, message_template, ["order 12  failed", "order 9 failed", " order 555 failed "]))) == 1


def test_profile_of_a_small_table(make):
    rows = [(1, "ab-1"), (2, "cd-2"), (3, None), (4, "ab-1"), (5, "longer-33")]
    found = {r["column"]: r for r in profile.profile_table(make(rows, "k int, v string"), ["k", "v"]).collect()}
    v = found["v"]
    assert (v["total_rows"], v["null_count"], v["distinct_count"], v["min_length"], v["max_length"]) == (5, 1, 3, 4, 9)
    assert v["value_patterns"] == ["AA-9", "A{6}-99"] and v["masked_samples"] == ["a**1", "c**2", "l*******3"]
    assert v["null_fraction"] == 0.2 and v["is_low_cardinality"]
    assert not found["k"]["is_low_cardinality"]


def test_profile_of_an_empty_table(make):
    row = profile.profile_table(make([], "k int"), ["k"]).collect()[0]
    assert (row["total_rows"], row["distinct_count"], row["null_fraction"], row["value_patterns"]) == (0, 0, 0.0, [])


def test_approximate_measures_agree_on_small_data(make):
    df = make([(i % 7, str(i)) for i in range(50)], "a int, b string")
    exact = {r["column"]: r["distinct_count"] for r in profile.column_measures(df, ["a", "b"]).collect()}
    sketch = {r["column"]: r["distinct_count"] for r in profile.approximate_measures(df, ["a", "b"]).collect()}
    assert exact["a"] == sketch["a"] == 7 and abs(exact["b"] - sketch["b"]) <= 2


def test_summaries_hold_no_raw_value(estate):
    raw = ["Acme Trading SRL", "carmen.i@mail.example", "+40 21 555 0101", "Net-30 terms agreed."]
    sources = estate({
        ("S", "CUSTOMERS"): (
            [(1, *raw), (2, "Beta Labs", "x.y@z.example", "+40 31 222 3344", "none")],
            "CUST_ID int, NAME string, EMAIL string, PHONE string, NOTE string", {"primary_key": ("CUST_ID",)},
        ),
        ("S", "ORDERS"): ([(10, 1), (11, 2)], "ORDER_ID int, CUST_ID int", {"primary_key": ("ORDER_ID",)}),
    })
    keyed = meaning.key_roles(sources.columns(), sources.constraints(), fk_discovery.discover(sources))
    rows = [r.asDict(recursive=True) for r in meaning.column_summaries(keyed, profile_estate(sources)).collect()]
    blob = json.dumps(rows)
    assert not any(value in blob for value in raw)
    reference = next(r for r in rows if r["table"] == "ORDERS" and r["column"] == "CUST_ID")
    assert reference["key_role"] == "foreign_key" and reference["references"] == "CUSTOMERS.CUST_ID (inferred)"
    email = next(r for r in rows if r["column"] == "EMAIL")
    assert email["value_patterns"] == ["email"] and "c***@m***.example" in email["masked_samples"]


def test_expressions_meet_only_values_that_may_fit(make):
    """Plain numbers are shaped without a look for addresses, and by no class of Unicode; odd values are named as ever."""
    plan = make([("1",)], "v string").select(structural_pattern(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert "contains(" in plan.lower() and "octet_length(" in plan.lower()
    values = ["٢٠٢٠-٠١-٠٢", "2020-01-02T03:04", " 2020-01-02 03:04:05\n", "2020-1-02", "é1²", "a@b.c", "a@b", "ü@é.ß", "x" * 36, "0" * 8 + "-0000" * 3 + "-" + "f" * 12]
    found = [r[0] for r in make([(v,) for v in values], "v string").select(structural_pattern(F.col("v"))).collect()]
    assert found == ["date", "date", "date", "9999-9-99", "A99", "email", "A@A", "email", "A{36}", "uuid"]
