"""Foreign-key rediscovery on small estates."""

from tablesense.functions.keys import key_text, tuple_key
from tablesense.operators import candidates as rules
from tablesense.operators.inclusion import inclusion, orphan_rows, overlap
from tablesense.plans import fk_discovery
from tablesense.sources.tables import local_rows
from pyspark.sql import functions as F


def edges(found):
    return {
        (r["rule"], r["table"], tuple(r["columns"]), r["parent_table"], r["confidence"], r["orphan_rows"])
        for r in found.collect()
    }


def shop(estate, **options):
    return estate({
        ("SHOP", "STATUS_REF"): ([(1, "new"), (2, "paid")], "STATUS_CD int, DESCR string", {"primary_key": ("STATUS_CD",)}),
        ("SHOP", "CUSTOMERS"): (
            [(i, f"name {i}", 1 + i % 2) for i in range(1, 5)], "CUST_ID int, NAME string, STATUS_CD int", {"primary_key": ("CUST_ID",)}
        ),
        ("SHOP", "PRODUCTS"): ([(1, "a"), (2, "b"), (3, "c")], "PROD_ID int, SKU string", {"primary_key": ("PROD_ID",), "unique_keys": (("SKU",),)}),
        ("SHOP", "ORDERS"): (
            [(1, 1, 1), (2, 2, 2)], "ORDER_ID int, CUST_ID int, STATUS_CD int",
            {"primary_key": ("ORDER_ID",), "foreign_keys": ((("CUST_ID",), "SHOP", "CUSTOMERS", ("CUST_ID",)),)},
        ),
        ("SHOP", "ORDER_ITEMS"): (
            [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 99), (5, 2, 1)], "ITEM_ID int, ORDER_ID int, PROD_ID int", {"primary_key": ("ITEM_ID",)}
        ),
        ("SHOP", "CUST_NOTES"): ([(1, "1"), (2, "2")], "NOTE_ID int, CUST_ID string", {"primary_key": ("NOTE_ID",)}),
    })


def test_exact_names_are_confirmed_by_data(estate):
    found = edges(fk_discovery.discover(shop(estate)))
    exact = {e[1:4] for e in found if e[0] == "exact"}
    assert ("ORDERS", ("STATUS_CD",), "STATUS_REF") in exact
    assert ("CUSTOMERS", ("STATUS_CD",), "STATUS_REF") in exact
    assert ("ORDER_ITEMS", ("ORDER_ID",), "ORDERS") in exact
    # 3 of 4 distinct products exist: below the threshold
    assert not any(e[1] == "ORDER_ITEMS" and e[2] == ("PROD_ID",) and e[3] == "PRODUCTS" for e in found)
    # the declared reference is not inferred again
    assert not any(e[1] == "ORDERS" and e[2] == ("CUST_ID",) for e in found)


def test_text_child_matches_numeric_parent(estate):
    row = fk_discovery.discover(shop(estate)).filter("table = 'CUST_NOTES' AND columns[0] = 'CUST_ID'").collect()[0]
    assert row["parent_table"] == "CUSTOMERS" and row["confidence"] == "high"
    assert any("type" in e for e in row["evidence"])


def test_overlap_counts_values_and_orphans_count_rows(make):
    child = make([(1,), (1,), (2,), (9,), (9,), (9,), (None,)], "k int")
    parent = make([(1,), (2,), (3,)], "k int")
    row = overlap(child, ["k"], parent, ["k"]).collect()[0]
    assert (row["distinct_total"], row["matched"], row["orphan_rows"]) == (3, 2, 3)
    assert orphan_rows(child, ["k"], parent, ["k"]).count() == 3


def test_child_without_values_has_no_overlap(make):
    child = make([(None,)], "k int")
    assert overlap(child, ["k"], make([(1,)], "k int"), ["k"]).count() == 0


def test_composite_needs_all_parts(make):
    child = make([(1, 1), (1, None), (2, 5)], "a int, b int")
    parent = make([(1, 1), (2, 2)], "a int, b int")
    row = overlap(child, ["a", "b"], parent, ["a", "b"]).collect()[0]
    assert (row["distinct_total"], row["matched"], row["orphan_rows"]) == (2, 1, 1)


def test_tuple_keys_do_not_collide(make):
    df = make([("a", "b:c"), ("a:b", "c")], "x string, y string")
    assert df.select(tuple_key([F.col("x"), F.col("y")]).alias("k")).distinct().count() == 2


def test_key_text_of_whole_numbers_agrees_across_types(make):
    df = make([(7, 7.0, "7")], "i int, d double, s string").withColumn("n", F.col("i").cast("decimal(10,2)"))
    texts = df.select(*[key_text(F.col(c), df.schema[c].dataType) for c in df.columns]).collect()[0]
    assert set(texts) == {"7"}
    half = make([(1.5,)], "d double").withColumn("n", F.lit("1.50").cast("decimal(10,2)"))
    assert set(half.select(*[key_text(F.col(c), half.schema[c].dataType) for c in half.columns]).collect()[0]) == {"1.5"}


def test_empty_text_can_count_as_null(make):
    child, parent = make([("",), ("1",)], "k string"), make([(1,)], "k int")
    assert overlap(child, ["k"], parent, ["k"]).collect()[0]["overlap"] == 0.5
    assert overlap(child, ["k"], parent, ["k"], empty_is_null=True).collect()[0]["overlap"] == 1.0


def test_self_reference_by_suffix(estate):
    people = [(i, max(1, i // 2), 100 + i % 2) for i in range(1, 9)]
    found = edges(fk_discovery.discover(estate({
        ("HR", "DEPARTMENTS"): ([(100, "x"), (101, "y")], "DEPARTMENT_ID int, NAME string", {"primary_key": ("DEPARTMENT_ID",)}),
        ("HR", "EMPLOYEES"): (people, "EMPLOYEE_ID int, MANAGER_ID int, DEPARTMENT_ID int", {"primary_key": ("EMPLOYEE_ID",)}),
    })))
    assert ("suffix", "EMPLOYEES", ("MANAGER_ID",), "EMPLOYEES", "high", 0) in found
    assert ("exact", "EMPLOYEES", ("DEPARTMENT_ID",), "DEPARTMENTS", "high", 0) in found
    assert len(found) == 2


def test_composite_keys_exact_and_role_named(estate):
    items = [(o, n) for o in range(1, 4) for n in range(1, 4)]
    found = edges(fk_discovery.discover(estate({
        ("S", "ORDER_ITEMS"): ([(o, n, "p") for o, n in items], "ORDER_ID int, ITEM_NO int, PRODUCT string", {"primary_key": ("ORDER_ID", "ITEM_NO")}),
        ("S", "ITEM_RETURNS"): ([(50, 1, 1), (51, 3, 2)], "RETURN_REF int, ORDER_ID int, ITEM_NO int", {"primary_key": ("RETURN_REF",)}),
        ("S", "RETURN_LINES"): ([(60, 1, 3, 1), (61, 2, 2, 4)], "LINE_REF int, SOURCE_ORDER_ID int, RETURN_ITEM_NO int, QTY int", {"primary_key": ("LINE_REF",)}),
    })))
    assert ("composite_exact", "ITEM_RETURNS", ("ORDER_ID", "ITEM_NO"), "ORDER_ITEMS", "high", 0) in found
    assert ("composite_suffix", "RETURN_LINES", ("SOURCE_ORDER_ID", "RETURN_ITEM_NO"), "ORDER_ITEMS", "high", 0) in found


def test_cross_schema_edges_are_tagged(estate):
    found = fk_discovery.discover(estate({
        ("HR", "LOCATIONS"): ([(1,), (2,)], "LOCATION_ID int", {"primary_key": ("LOCATION_ID",)}),
        ("EXT", "CONTACTS"): ([(10, 1), (11, 2)], "CONTACT_REF int, LOCATION_ID int", {"primary_key": ("CONTACT_REF",)}),
    })).collect()
    assert [(r["owner"], r["parent_owner"], r["cross_schema"]) for r in found] == [("EXT", "HR", True)]


def test_twin_surrogate_keys_are_suppressed_in_both_directions(estate):
    rows = [(i,) for i in range(5)]
    both = estate({
        ("S", "A"): (rows, "ROW_KEY int", {"primary_key": ("ROW_KEY",)}),
        ("S", "B"): (rows, "ROW_KEY int", {"primary_key": ("ROW_KEY",)}),
    })
    assert fk_discovery.discover(both).count() == 0
    one_way = estate({
        ("S", "A"): (rows, "ROW_KEY int", {"primary_key": ("ROW_KEY",)}),
        ("S", "B"): (rows[:2], "ROW_KEY int", {"primary_key": ("ROW_KEY",)}),
    })
    assert edges(fk_discovery.discover(one_way)) == {("exact", "B", ("ROW_KEY",), "A", "high", 0)}


def test_best_overlap_wins_and_orphans_lower_the_grade(estate):
    found = fk_discovery.discover(estate({
        ("S", "A"): ([(i,) for i in range(9)], "AREA_CD int", {"primary_key": ("AREA_CD",)}),
        ("S", "B"): ([(i,) for i in range(2)], "AREA_CD int", {"primary_key": ("AREA_CD",)}),
        ("S", "C"): ([(i % 10,) for i in range(30)], "AREA_CD int", {}),
    }))
    row = found.filter("table = 'C'").collect()[0]
    assert (row["parent_table"], row["confidence"], row["orphan_rows"]) == ("A", "medium", 3)
    assert "90%" in row["evidence"][-1]


def test_empty_tables_and_their_limits(estate):
    sources = estate({
        ("S", "P"): ([], "K_ID int", {"primary_key": ("K_ID",)}),
        ("S", "C"): ([(1,)], "K_ID int", {}),
    })
    assert fk_discovery.all_candidates(sources).count() == 2  # by name and by suffix
    assert fk_discovery.all_candidates(sources, counts=sources.row_counts()).count() == 0
    assert fk_discovery.discover(sources).count() == 0


def test_offline_keeps_only_unambiguous_names_at_low_confidence(estate):
    found = edges(fk_discovery.offline(shop(estate)))
    assert ("exact", "ORDER_ITEMS", ("PROD_ID",), "PRODUCTS", "low", None) in found
    assert all(e[4] == "low" and e[0] != "suffix" for e in found)
    ambiguous = estate({
        ("S", "A"): ([(1,)], "X_CD int", {"primary_key": ("X_CD",)}),
        ("S", "B"): ([(1,)], "X_CD int", {"unique_keys": (("X_CD",),)}),
        ("S", "C"): ([(1,)], "X_CD int", {}),
    })
    assert not any(e[1] == "C" for e in edges(fk_discovery.offline(ambiguous)))


def test_composite_choices_have_no_cap(estate):
    columns = ", ".join(f"c{i}_ID int" for i in range(6))
    wide = estate({
        ("S", "P"): ([(1, 1)], "a_ID int, b_ID int", {"primary_key": ("a_ID", "b_ID")}),
        ("S", "C"): ([tuple([1] * 6)], columns, {}),
    })
    assert rules.composite_suffix(rules.CatalogFrames.of(wide)).count() == 30  # 36 choices less 6 repeats
    narrow = estate({
        ("S", "P"): ([(1, 1)], "a_ID int, b_ID int", {"primary_key": ("a_ID", "b_ID")}),
        ("S", "C"): ([(1, 1, 1)], "x_ID int, y_ID int, z_ID int", {}),
    })
    assert rules.composite_suffix(rules.CatalogFrames.of(narrow)).count() == 6  # 9 choices less 3 repeats


def test_inclusion_matches_brute_force_with_a_hot_value(spark, make):
    rows = [(7,)] * 500 + [(i,) for i in range(60)]
    tables = {("S", "C"): make(rows, "v int"), ("S", "P"): make([(i,) for i in range(40)], "v int")}
    pairs = local_rows(spark, [("S", "C", ["v"], "S", "P", ["v"])],
                       "owner string, table string, columns array<string>, parent_owner string, parent_table string, parent_columns array<string>")
    row = inclusion(tables, pairs).collect()[0]
    values = [r[0] for r in rows]
    assert row["distinct_total"] == len(set(values))
    assert row["matched"] == len([v for v in set(values) if v < 40])
    assert row["orphan_rows"] == len([v for v in values if v >= 40])


def test_declared_reference_to_another_owner_keeps_its_target(estate):
    sources = estate({
        ("A", "P"): ([(1,)], "K int", {"primary_key": ("K",)}),
        ("B", "C"): ([(1,)], "K int", {"foreign_keys": ((("K",), "A", "P", ("K",)),)}),
    })
    row = fk_discovery.declared(sources.constraints()).collect()[0]
    assert (row["parent_owner"], row["declared"], row["confidence"], row["cross_schema"]) == ("A", True, "high", True)


def test_composite_key_among_many_columns_is_found(estate):
    columns = ", ".join(f"c{i}_ID int" for i in range(8))
    pairs = [(i, 100 + i % 7) for i in range(40)]
    sources = estate({
        ("S", "P"): (pairs, "a_ID int, b_ID int", {"primary_key": ("a_ID", "b_ID")}),
        ("S", "C"): ([(a, b, *[1000 + a] * 6) for a, b in pairs], columns, {}),
    })
    found = {e[:5] for e in edges(fk_discovery.discover(sources)) if e[0] == "composite_suffix"}
    assert [e[2] for e in found] == [("c0_ID", "c1_ID")]


def test_pruned_pairs_could_not_reach_the_threshold(spark, make):
    from itertools import product

    from tablesense.sources.tables import local_rows as local

    values = {"a": range(100), "b": range(50, 150), "c": range(10), "d": [], "e": range(1000, 1100), "f": [*range(95), *range(500, 505)]}
    tables = {("S", n): make([(v,) for v in vs], "v int") for n, vs in values.items()}
    schema = "owner string, table string, columns array<string>, parent_owner string, parent_table string, parent_columns array<string>"
    pairs = local(spark, [("S", a, ["v"], "S", b, ["v"]) for a, b in product(values, values) if a != b], schema)
    whole = {(r["table"], r["parent_table"]): r["overlap"] for r in inclusion(tables, pairs).collect()}
    kept = {(r["table"], r["parent_table"]): r["overlap"] for r in inclusion(tables, pairs, at_least=0.85).collect()}
    assert {k: v for k, v in whole.items() if v >= 0.85} == {k: v for k, v in kept.items() if v >= 0.85}
    assert len(kept) < len(whole)


def test_whole_floating_keys_compare_as_numbers_at_any_size(make):
    big = [10**15 + i for i in range(10)] + [2**60, 7]
    child, parent = make([(v,) for v in big], "k long"), make([(float(v),) for v in big], "k double")
    row = overlap(child, ["k"], parent, ["k"]).collect()[0]
    assert (row["overlap"], row["orphan_rows"]) == (1.0, 0)


def test_hundreds_of_tables_with_dense_ids(spark):
    """500 tables whose ids all begin at 0: a pair costs signatures, and each overlap is the smaller range's share."""
    sizes = {f"T{i:03d}": 1 + (i * 7) % 40 for i in range(500)}
    tables = {("S", name): spark.range(0, n, 1, 1).selectExpr("id as k") for name, n in sizes.items()}
    names = list(sizes)
    pairs = [(names[i], names[j]) for i in range(500) for j in {(i * 31 + 7 * s) % 500 for s in range(1, 6)} if i != j]
    candidates = local_rows(
        spark, [("S", a, ["k"], "S", b, ["k"]) for a, b in pairs],
        "owner string, table string, columns array<string>, parent_owner string, parent_table string, parent_columns array<string>",
    )
    found = {(r["table"], r["parent_table"]): (r["distinct_total"], r["matched"], r["orphan_rows"]) for r in inclusion(tables, candidates).collect()}
    assert found == {(a, b): (sizes[a], min(sizes[a], sizes[b]), max(0, sizes[a] - sizes[b])) for a, b in pairs}


def test_a_column_is_text_to_one_parent_and_a_number_to_another(spark, make):
    tables = {
        ("S", "C"): make([(1,), (2,), (2,), (7,)], "v int"), ("S", "N"): make([(1,), (2,)], "v long"), ("S", "T"): make([("2",), ("07",), ("x",)], "v string"),
    }
    schema = "owner string, table string, columns array<string>, parent_owner string, parent_table string, parent_columns array<string>"
    pairs = [("C", "N"), ("C", "T"), ("T", "C"), ("N", "C")]
    candidates = local_rows(spark, [("S", a, ["v"], "S", b, ["v"]) for a, b in pairs], schema)
    found = {(r["table"], r["parent_table"]): (r["distinct_total"], r["matched"], r["orphan_rows"]) for r in inclusion(tables, candidates).collect()}
    assert found == {("C", "N"): (3, 2, 1), ("C", "T"): (3, 1, 2), ("T", "C"): (3, 1, 2), ("N", "C"): (2, 2, 0)}


def test_declared_references_are_measured_and_come_before_found_ones(estate):
    """A single key, a composite one, one to another owner, one out of reach, the same one declared twice; an empty child."""
    pair = ("K1", "K2")
    sources = estate({
        ("A", "P"): ([(1,), (2,)], "P_ID int", {"primary_key": ("P_ID",)}),
        ("A", "Q"): ([(1, 1), (1, 2)], "K1 int, K2 int", {"primary_key": pair}),
        ("B", "C"): ([(1, 1, 1, 2), (2, 1, 9, 2), (7, 1, 2, 2), (None, None, 2, 1)], "P_ID int, K1 int, K2 int, OTHER_P_ID int", {"foreign_keys": (
            (("P_ID",), "A", "P", ("P_ID",)), (("P_ID",), "A", "P", ("P_ID",)), (pair, "A", "Q", pair), (("K1",), "Z", "GONE", ("X",)),
        )}),
        ("B", "E"): ([], "P_ID int", {"foreign_keys": ((("P_ID",), "A", "P", ("P_ID",)),)}),
    })
    rows = fk_discovery.relationships(sources, threshold=0.5).collect()
    seen = sorted((r["table"], tuple(r["columns"]), r["parent_table"], r["declared"], r["orphan_rows"] or 0) for r in rows)
    assert seen == [
        ("C", ("K1",), "GONE", True, 0), ("C", ("K1", "K2"), "Q", True, 1), ("C", ("OTHER_P_ID",), "P", False, 0),
        ("C", ("P_ID",), "P", True, 1), ("C", ("P_ID",), "P", True, 1), ("E", ("P_ID",), "P", True, 0),
    ]
