import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.operators import columns, filters, matching, reshape
from cohortspan.operators.checks import range_check
from cohortspan.tables import GLOBAL_DEFAULTS, PAYMENT_DEFAULTS, STATE_FIELDS, fields_frame


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 2, 3.5), (2, None, 1.0)], "id int, a int, b double")
    long = reshape.to_long(df, ["id"])
    assert rows(long) == [(1, "a", 2.0), (1, "b", 3.5), (2, "a", None), (2, "b", 1.0)]
    wide = reshape.to_wide(long, ["id"], "name", "value", ["a", "b"])
    assert rows(wide, "id") == [(1, 2.0, 3.5), (2, None, 1.0)]


def test_repeat_rows(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, -1), (4, None)], "id int, n int")
    assert rows(reshape.repeat_rows(df, F.col("n"), "k").select("id", "k")) == [(1, 0), (1, 1)]


def test_split_and_matrix(spark):
    df = spark.createDataFrame([(1, " 0.0 0.01  x"), (2, "5")], "id int, v string")
    assert rows(reshape.split_cells(df, "v"), "id", "v") == [
        (1, None), (1, 0.0), (1, 0.01), (2, 5.0),
    ]
    grid = spark.createDataFrame(
        [(1, [[1.0, 2.0], [3.0, 4.0]]), (2, None), (3, [[]])], "id int, m array<array<double>>"
    )
    assert rows(reshape.matrix_cells(grid, "m")) == [
        (1, 1, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 1, 3.0), (1, 2, 2, 4.0),
    ]


def test_flag_cells(spark):
    df = spark.createDataFrame([("p", None, "ok"), ("q", "ok", None)], "n string, a string, b string")
    assert rows(reshape.flag_cells(df, ["n"], ["a", "b"]), "n") == [
        ("p", "b", None, None, None), ("q", "a", None, None, None),
    ]


def test_titles(spark):
    fields = fields_frame(spark, STATE_FIELDS)
    df = spark.createDataFrame([("t", 1, 0)], "treatment string, p_prog int, other int")
    assert columns.with_titles(df, fields).columns == ["Treatment", "Pr.prog", "other"]
    assert rows(columns.get_titles(df, fields), "position") == [
        (1, "treatment", "Treatment"), (2, "p_prog", "Pr.prog"), (3, "other", None),
    ]


def test_parameters(spark):
    df = spark.createDataFrame(
        [(1, "discount", 0.03), (1, "time_horizon", 10.0), (2, "discount", None)],
        "s int, name string, value double",
    )
    found = columns.parameters(df, ["s"], GLOBAL_DEFAULTS)
    assert found.columns == ["s", *GLOBAL_DEFAULTS]
    assert rows(found, "s") == [(1, 0.03, 0.0, 10.0, 1.0), (2, 0.0, 0.0, 20.0, 1.0)]
    assert rows(columns.parameter(df, ["s"], "control_count", 1.0), "s") == [(1, 1.0), (2, 1.0)]


def test_absent_is_not_blank(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "payment string, tot_payment double")
    filled = columns.fill_defaults(df, PAYMENT_DEFAULTS)
    assert [(r["tot_payment"], r["contract_length"]) for r in filled.orderBy("payment").collect()] == [
        (5.0, 20.0), (0.0, 20.0),
    ]
    mixed = spark.createDataFrame(
        [("a", None, ["contract_length"]), ("b", None, ["refund"]), ("c", 3.0, None)],
        "payment string, contract_length double, present_columns array<string>",
    )
    filled = columns.fill_defaults(mixed, PAYMENT_DEFAULTS).orderBy("payment")
    assert [r["contract_length"] for r in filled.collect()] == [0.0, 20.0, 3.0]
    kept = columns.fill_defaults(mixed, PAYMENT_DEFAULTS, blank=None).orderBy("payment")
    assert [r["contract_length"] for r in kept.collect()] == [None, 20.0, 3.0]


def test_map_and_sum_by_type(spark):
    df = spark.createDataFrame([("x", 1.26, 1), ("x", None, 2)], "k string, v double, n int")
    rounded = columns.map_columns(df, T.DoubleType, lambda c: F.round(c, 1))
    assert rows(rounded, "n") == [("x", 1.3, 1), ("x", None, 2)]
    assert rows(columns.sum_numeric(df, ["k"])) == [("x", 1.26, 3)]
    empty = df.where("v IS NULL")
    assert rows(columns.sum_numeric(empty, ["k"])) == [("x", 0.0, 2)]


def test_overrides(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 3.0, 4)], "s int, name string, v double, n int")
    changes = spark.createDataFrame(
        [(1, "a", "v", 9.0), (1, "a", "n", 8.0), (1, "z", "v", 0.0), (1, "a", "w", 0.0)],
        "s int, name string, column_name string, value double",
    )
    done = columns.override_cells(df, changes, ["s", "name"], ["v", "n"])
    assert rows(done, "name") == [(1, "a", 9.0, 8), (1, "b", 3.0, 4)]
    lost = columns.unknown_overrides(df, changes, ["s", "name"])
    assert sorted(r["message"] for r in lost.collect()) == [
        "Could not find column: w", "Could not find row: 1/z",
    ]


def test_predicates_and_profiles(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a"), (2, None, "b"), (3, 9.0, "b"), (4, 4.0, None)], "i int, v double, t string"
    )
    kept = filters.first_matches(df, {"v": (2, 5)}, ["i"])
    assert [r["i"] for r in kept.collect()] == [1, 4]
    assert filters.first_matches(df, {}, ["i"], 3).count() == 3
    both = filters.first_matches(df, {"v": (2, 5), "t": ["a", "b"]}, ["i"])
    assert [r["i"] for r in both.collect()] == [1]
    assert rows(filters.number_ranges(df, ["i", "v"])) == [("i", 1.0, 4.0), ("v", 2.0, 9.0)]
    assert rows(filters.text_levels(df, ["t"])) == [("t", "a"), ("t", "b")]


def test_unmatched_ignores_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    assert rows(matching.unmatched(left, right, ["k"])) == [(1,)]


def test_range_check(spark):
    df = spark.createDataFrame(
        [(1, 0.5, -1.0), (2, 7.0, None), (3, None, 3.0)], "row_id int, a double, b double"
    )
    limits = {"a": ("A", 0.0, 1.0), "b": ("B", 0.0, None)}
    found = range_check(df, limits, "t", "row_id", with_position=True)
    assert rows(found, "row") == [
        ("t", "B", 1, "Value -1.00 is below minimum value", 2),
        ("t", "A", 2, "Value 7.00 is above maximum value", 3),
    ]
    assert range_check(df, {}, "t", "row_id").count() == 0
    with pytest.raises(Exception):
        range_check(df, limits, "t", "missing").count()
