"""Generic table operators on orders, line items, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.catalog.part_model import read
from cohortspan.catalog.registry import query
from cohortspan.functions import discount_factor, hazard
from cohortspan.operators import columns, filters, matching, reshape
from cohortspan.operators.checks import range_check
from cohortspan.operators.expand import expand_knots
from cohortspan.operators.scan import group_size, ordered_scan, position, running_sum, sum_before
from cohortspan.operators.schedule import payment_schedule
from cohortspan.plans.sweep import variation_rows


@query(
    "discounted_value",
    """
    SELECT l_returnflag,
           round(sum(l_extendedprice * power(1.03e0, -(year(l_shipdate) - 1992))), 2) AS value
    FROM lineitem GROUP BY l_returnflag
    """,
)
def discounted_value(spark, sf_dir):
    period = F.year("l_shipdate") - 1991
    worth = F.col("l_extendedprice") * discount_factor(F.lit(0.03), period)
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.round(F.sum(worth), 2).alias("value"))
    )


@query(
    "survival_hazard",
    """
    SELECT o_custkey,
           round(CASE WHEN share = 0 THEN 1e0 ELSE 1 - exp(ln(share) / 5) END, 6) AS hazard
    FROM (SELECT o_custkey,
                 count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE AS share
          FROM orders GROUP BY o_custkey)
    """,
)
def survival_hazard(spark, sf_dir):
    done = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    shares = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(done.alias("share"))
    return shares.select(
        "o_custkey", F.round(hazard(F.col("share"), F.lit(5)), 6).alias("hazard")
    )


@query(
    "installments",
    """
    WITH c AS (SELECT o_orderkey, o_totalprice AS total, 1 + o_orderkey % 12 AS n,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 0.5e0 WHEN '2-HIGH' THEN 0.25e0
                           ELSE 0e0 END AS first
               FROM orders)
    SELECT o_orderkey, t::INTEGER AS time,
           round(CASE WHEN first > 0 AND t = 1 THEN total * first
                      WHEN first > 0 THEN total * (1 - first) / greatest(n - 1, 1)
                      ELSE total / n END, 8) AS amount
    FROM c, generate_series(1, least(10, n)) AS g(t)
    """,
)
def installments(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    schedule = payment_schedule(
        orders,
        "10",
        columns={
            "tot_payment": "o_totalprice",
            "contract_length": "1 + o_orderkey % 12",
            "initial_payment": "CASE o_orderpriority WHEN '1-URGENT' THEN 0.5D "
            "WHEN '2-HIGH' THEN 0.25D ELSE 0D END",
        },
        only_due=True,
        payment="amount",
        keep=["o_orderkey"],
    )
    return schedule.withColumn("amount", F.round("amount", 8))


@query(
    "continuous_plan",
    """
    SELECT s_suppkey, t::INTEGER AS time,
           round(s_acctbal / 100 * power(1 + (s_nationkey - 12) / 200e0, -(t - 1))
                 * power(1.03e0, -(t - 1)), 6) AS amount
    FROM supplier, generate_series(1, 10) AS g(t)
    """,
)
def continuous_plan(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    schedule = payment_schedule(
        suppliers,
        "10",
        columns={"cont_payment": "s_acctbal / 100", "cost_trend": "(s_nationkey - 12) / 200D"},
        discount="0.03D",
        payment="amount",
        keep=["s_suppkey"],
    )
    return schedule.withColumn("amount", F.round("amount", 6))


# column -> (title, min, max)
LINE_LIMITS = {
    "l_quantity": ("Quantity", 2.0, 49.0),
    "l_extendedprice": ("Price", 1000.0, None),
    "l_discount": ("Discount", 0.01, 0.09),
    "l_tax": ("Tax", None, 0.07),
}


@query(
    "range_violations",
    """
    WITH limits(name, title, low, high) AS (VALUES
             ('l_quantity', 'Quantity', 2e0, 49e0), ('l_extendedprice', 'Price', 1000e0, NULL),
             ('l_discount', 'Discount', 0.01e0, 0.09e0), ('l_tax', 'Tax', NULL, 0.07e0)),
         long AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
                                  l_discount, l_tax FROM lineitem)
                  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)
    SELECT l_orderkey, 'lineitem' AS "table", title AS "column", l_linenumber::BIGINT AS "row",
           'Value ' || printf('%.2f', value + 0e0) || ' is ' ||
           CASE WHEN value < low THEN 'below minimum value' ELSE 'above maximum value' END
               AS message
    FROM long JOIN limits USING (name)
    WHERE value < low OR value > high
    """,
)
def range_violations(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_LIMITS)
    return range_check(lines, LINE_LIMITS, "lineitem", "l_linenumber", keys=["l_orderkey"])


@query(
    "unmatched_keys",
    """
    SELECT 'customer' AS "table", c_custkey AS "row" FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                      AND o_orderstatus = 'F' AND year(o_orderdate) = 1995)
    UNION ALL
    SELECT 'orders', o_orderkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM customer
                      WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
    """,
)
def unmatched_keys(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    done = orders.where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1995))
    building = customer.where(F.col("c_mktsegment") == "BUILDING")
    idle = matching.unmatched(customer, done, ["key"])
    outside = matching.unmatched(orders, building, ["key"])
    return idle.select(F.lit("customer").alias("table"), F.col("key").alias("row")).unionByName(
        outside.select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("row"))
    )


@query(
    "knot_interpolation",
    """
    WITH k AS (SELECT p_brand, p_partkey, 1 + p_size % 4 AS n,
                      CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS v FROM part),
         a AS (SELECT *, coalesce(lead(v) OVER w, 0) AS target,
                      max(CASE WHEN v IS NOT NULL THEN p_partkey END)
                          OVER (w ROWS UNBOUNDED PRECEDING) AS segment,
                      last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS filled,
                      coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                          AS before
               FROM k WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
         b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY p_brand, segment ORDER BY p_partkey
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside,
                      sum(n) OVER (PARTITION BY p_brand, segment) AS length
               FROM a)
    SELECT p_brand, p_partkey, (before + i + 1)::INTEGER AS step,
           round(filled - (filled - target) * (inside + i) / length, 6) AS value
    FROM b, generate_series(0, n - 1) AS g(i)
    """,
)
def knot_interpolation(spark, sf_dir):
    knots = read(spark, sf_dir, "part").select(
        "p_brand",
        "p_partkey",
        (1 + F.col("p_size") % 4).alias("n"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("value"),
    )
    expanded = expand_knots(knots, ["p_brand"], ["p_partkey"], "value", periods=F.col("n"))
    return expanded.select("p_brand", "p_partkey", "step", F.round("value", 6).alias("value"))


@query(
    "predicate_filter",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_custkey BETWEEN 10 AND 1000000
      AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')
    ORDER BY o_orderkey LIMIT 12
    """,
)
def predicate_filter(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    choices = {
        "o_totalprice": (100000, 300000),
        "o_custkey": (10, 1000000),
        "o_orderpriority": ["1-URGENT", "3-MEDIUM"],
    }
    return filters.first_matches(orders, choices, ["o_orderkey"])


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE + 0e0 AS low, max({c})::DOUBLE AS high "
        "FROM lineitem"
        for c in _PROFILED
    ),
)
def column_profile(spark, sf_dir):
    ranges = filters.number_ranges(read(spark, sf_dir, "lineitem"), _PROFILED)
    return ranges.withColumn("low", F.col("low") + F.lit(0.0))


@query(
    "column_levels",
    """
    SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS level FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
    """,
)
def column_levels(spark, sf_dir):
    return filters.text_levels(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "long_numbers",
    """
    SELECT l_returnflag, name, round(sum(value), 2) AS total, count(*) AS n
    FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax
                   FROM lineitem)
          ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)
    GROUP BY l_returnflag, name
    """,
)
def long_numbers(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return (
        reshape.to_long(lines, ["l_returnflag"])
        .groupBy("l_returnflag", "name")
        .agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))
    )


@query(
    "flag_cells",
    """
    WITH f AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'x' END AS large,
                      CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' END AS urgent,
                      CASE WHEN o_orderstatus = 'O' THEN 'x' END AS open FROM orders)
    SELECT o_orderkey, variable, NULL::DOUBLE AS v1, NULL::DOUBLE AS v2, NULL::DOUBLE AS v3
    FROM (UNPIVOT f ON large, urgent, open INTO NAME variable VALUE mark)
    """,
)
def flag_cells(spark, sf_dir):
    flags = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 300000, "x").alias("large"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "x").alias("urgent"),
        F.when(F.col("o_orderstatus") == "O", "x").alias("open"),
    )
    return reshape.flag_cells(flags, ["o_orderkey"], ["large", "urgent", "open"])


@query(
    "split_values",
    """
    SELECT p_partkey, try_cast(token AS DOUBLE) AS value
    FROM (SELECT p_partkey, unnest(string_split(concat_ws(' ', p_size, p_partkey % 7, 'n/a',
                                                          p_retailprice), ' ')) AS token
          FROM part)
    """,
)
def split_values(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("concat_ws(' ', p_size, p_partkey % 7, 'n/a', p_retailprice)").alias("value"),
    )
    return reshape.split_cells(cells, "value")


@query(
    "multi_value_cells",
    """
    WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS row_name, column_name, value FROM (
                   SELECT p_partkey, 'p_HU' AS column_name,
                          CASE WHEN p_size % 2 = 0 THEN concat_ws(' ', p_size / 100e0, 0.5)
                               ELSE '0.1' END AS value FROM part
                   UNION ALL
                   SELECT p_partkey, 'note', p_name FROM part))
    SELECT 'treatment_table' AS table_name, row_name, column_name,
           unnest(string_split(value, ' '))::DOUBLE AS value
    FROM t WHERE try_cast(value AS DOUBLE) IS NULL AND regexp_matches(value, '^[0-9. ]+$')
    """,
)
def multi_value_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("name"),
        F.expr(
            "IF(p_size % 2 = 0, concat_ws(' ', p_size / 100D, '0.5'), '0.1')"
        ).alias("p_HU"),
        F.col("p_name").alias("note"),
    )
    return variation_rows(cells, "treatment_table", "name")


_PRIORITIES = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "unspecified",
    "5-LOW": "low",
}


@query(
    "pivot_kv",
    "SELECT c_mktsegment, "
    + ", ".join(
        f"nullif(count(*) FILTER (WHERE o_orderpriority = '{k}'), 0) AS {v}"
        for k, v in _PRIORITIES.items()
    )
    + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
def pivot_kv(spark, sf_dir):
    # Orders are counted per customer first, so the join sees no frequent key.
    counts = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(F.count("*").alias("n"))
    )
    segments = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    long = (
        counts.join(segments, "o_custkey")
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("n").alias("n"))
    )
    wide = reshape.to_wide(long, ["c_mktsegment"], "o_orderpriority", "n", list(_PRIORITIES))
    return wide.withColumnsRenamed(_PRIORITIES)


@query(
    "repeat_rows",
    """
    SELECT p_partkey, i::INTEGER AS copy FROM part, generate_series(0, p_size % 4 - 1) AS g(i)
    """,
)
def repeat_rows(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return reshape.repeat_rows(part, F.col("p_size") % 4, "copy").select("p_partkey", "copy")


@query(
    "type_sums",
    """
    SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity,
           round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 2) AS l_tax
    FROM lineitem GROUP BY l_returnflag
    """,
)
def type_sums(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_tax"
    )
    sums = columns.sum_numeric(lines, ["l_returnflag"])
    return columns.map_columns(sums, T.DoubleType, lambda value: F.round(value, 2))


@query(
    "override_cells",
    """
    SELECT p_partkey,
           coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, p_retailprice) AS p_retailprice,
           coalesce(CASE WHEN s_acctbal <= 5000 THEN s_nationkey END, p_size)::INTEGER AS p_size
    FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3
    """,
)
def override_cells(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    changes = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 3 AS p_partkey",
        "IF(s_acctbal > 5000, 'p_retailprice', 'p_size') AS column_name",
        "IF(s_acctbal > 5000, s_acctbal, CAST(s_nationkey AS DOUBLE)) AS value",
    )
    return columns.override_cells(part, changes, ["p_partkey"], ["p_retailprice", "p_size"])


@query(
    "unknown_overrides",
    """
    SELECT s_suppkey * 500 AS p_partkey, s_name AS column_name,
           'Could not find column: ' || s_name AS message FROM supplier WHERE s_nationkey < 5
    UNION ALL
    SELECT s_suppkey * 500, CASE WHEN s_nationkey < 5 THEN s_name ELSE 'p_size' END,
           'Could not find row: ' || (s_suppkey * 500)
    FROM supplier WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = s_suppkey * 500)
    """,
)
def unknown_overrides(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    changes = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 500 AS p_partkey", "IF(s_nationkey < 5, s_name, 'p_size') AS column_name"
    )
    return columns.unknown_overrides(part, changes, ["p_partkey"])


@query(
    "running_totals",
    """
    SELECT o_orderkey, row_number() OVER w AS nth, count(*) OVER (PARTITION BY o_custkey) AS n,
           round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running,
           round(coalesce(sum(o_totalprice)
               OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def running_totals(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    seen = ordered_scan(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        nth=position(),
        n=group_size(),
        running=running_sum(F.col("o_totalprice")),
        before=sum_before(F.col("o_totalprice")),
    )
    return seen.select(
        "o_orderkey",
        "nth",
        "n",
        F.round("running", 2).alias("running"),
        F.round("before", 2).alias("before"),
    )


@query(
    "first_per_group",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (
               PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
           THEN o_totalprice END AS first_total
    FROM orders
    """,
)
def first_per_group(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    nth = ordered_scan(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], nth=position())
    return nth.select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("nth") == 1, F.col("o_totalprice")).alias("first_total"),
    )


@query(
    "rows_between",
    """
    SELECT o_custkey, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
            BETWEEN 2 AND 3
    """,
)
def rows_between(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    chosen = filters.rows_between(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 3)
    return chosen.select("o_custkey", "o_orderkey")


@query(
    "top_by_group",
    """
    SELECT p_brand, p_partkey FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC)
            <= 1 + length(p_brand) % 4
    """,
)
def top_by_group(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey")
    count = 1 + F.length("p_brand") % 4
    return filters.top_by_group(part, ["p_brand"], "p_partkey", count)


@query(
    "bucket_assign",
    """
    WITH w AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n
               FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
         b AS (SELECT c_mktsegment, o_orderpriority,
                      sum(n) OVER (PARTITION BY c_mktsegment ORDER BY o_orderpriority)::DOUBLE
                      / sum(n) OVER (PARTITION BY c_mktsegment) AS hi,
                      (sum(n) OVER (PARTITION BY c_mktsegment ORDER BY o_orderpriority) - n)::DOUBLE
                      / sum(n) OVER (PARTITION BY c_mktsegment) AS lo
               FROM w),
         d AS (SELECT c_custkey, c_mktsegment, (c_custkey * 7919 % 10007 + 1) / 10007e0 AS u
               FROM customer)
    SELECT c_custkey, o_orderpriority FROM d JOIN b USING (c_mktsegment) WHERE u > lo AND u <= hi
    """,
)
def bucket_assign(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    counts = read(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), "o_orderpriority"
    ).agg(F.count("*").alias("n"))
    weights = (
        counts.join(customer, "c_custkey")
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("n").alias("n"))
    )
    buckets = matching.cumulative_shares(weights, ["c_mktsegment"], "o_orderpriority", "n")
    draws = customer.withColumn("u", F.expr("(c_custkey * 7919 % 10007 + 1) / 10007D"))
    return matching.assign_buckets(draws, buckets, ["c_mktsegment"], "u", "o_orderpriority").select(
        "c_custkey", "o_orderpriority"
    )


@query(
    "bucket_many_labels",
    """WITH b AS (SELECT o_orderstatus, o_orderkey, sum(w) OVER s / sum(w) OVER (PARTITION BY o_orderstatus) AS upper
                  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)
                  WINDOW s AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)),
    f AS (SELECT o_orderstatus, upper, min(o_orderkey) AS o_orderkey FROM b GROUP BY ALL),
    d AS (SELECT l_orderkey, l_linenumber, l_linestatus,
                 (l_orderkey * 7919 + l_linenumber * 104729) % 1000003 / 1000003e0 AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, o_orderkey FROM d ASOF LEFT JOIN f ON l_linestatus = o_orderstatus AND u <= upper""",
)
def bucket_many_labels(spark, sf_dir):
    """An order drawn for each line item, by price among the orders of its status: thousands in a group."""
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus", "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) AS w"
    )
    draws = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus AS o_orderstatus",
        "(l_orderkey * 7919 + l_linenumber * 104729) % 1000003 / 1000003D AS u",
    )
    shares = matching.cumulative_shares(orders, ["o_orderstatus"], "o_orderkey", "w")
    found = matching.assign_buckets(draws, shares, ["o_orderstatus"], "u", "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "o_orderkey")
