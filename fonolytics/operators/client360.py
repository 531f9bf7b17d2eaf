"""One row per client over all its products (R4), and the product lines behind it.

Money is summed in whole cents (exact integers), so the totals do not depend
on the order in which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    return F.round(x * F.lit(100.0)).cast("bigint")


def from_cents(x: Column) -> Column:
    return x.cast("double") / F.lit(100.0)


def product_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Product line = order: capital = sum of line prices, payoff = lines net
    of discount plus tax, debt = the order total. Lines are combined per
    order before the join, so the join sees one row per order."""
    li = lineitem.groupBy("l_orderkey").agg(
        F.sum(cents(F.col("l_extendedprice"))).alias("capital_c"),
        F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))).alias("cancelacion_c"),
    )
    od = orders.select("o_orderkey", "o_custkey", cents(F.col("o_totalprice")).alias("deuda_c"))
    return od.join(li, od.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").alias("producto"),
        F.coalesce("capital_c", F.lit(0).cast("bigint")).alias("capital_c"),
        "deuda_c",
        F.coalesce("cancelacion_c", F.lit(0).cast("bigint")).alias("cancelacion_c"),
    )


def client_360(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per client, number of products, total capital, total debt and payoff amount.

    Clients without products appear with zeros. For some clients only, use
    ``client_lookup``: a filter on this result would still combine all lines.
    """
    per_client = product_lines(orders, lineitem).groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_productos"),
        F.sum("capital_c").alias("capital_c"),
        F.sum("deuda_c").alias("deuda_c"),
        F.sum("cancelacion_c").alias("cancelacion_c"),
    )
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    return c.join(per_client, "c_custkey", "left").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.coalesce("n_productos", F.lit(0).cast("bigint")).alias("n_productos"),
        from_cents(F.coalesce("capital_c", F.lit(0).cast("bigint"))).alias("capital_total"),
        from_cents(F.coalesce("deuda_c", F.lit(0).cast("bigint"))).alias("deuda_total"),
        from_cents(F.coalesce("cancelacion_c", F.lit(0).cast("bigint"))).alias("importe_cancelacion"),
    )


def client_products(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """R4 detail: every product line of every client, one row each.

    Kept flat rather than as one array per client: a client holding a third
    of all products would otherwise become one enormous row in one task.
    """
    return product_lines(orders, lineitem).select(
        "c_custkey",
        "producto",
        from_cents(F.col("capital_c")).alias("capital"),
        from_cents(F.col("deuda_c")).alias("deuda"),
        from_cents(F.col("cancelacion_c")).alias("importe_cancelacion"),
    )


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Rows whose columns equal the given values, e.g. ``lookup(c360, c_custkey=42)``.

    A plain filter: on stored tables it reaches the scan as a pushed filter.
    """
    cond = None
    for col, value in equals.items():
        c = F.col(col) == F.lit(value)
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def client_lookup(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, which: Column) -> DataFrame:
    """``client_360`` of the clients that ``which`` (over customer columns) picks.

    The clients are picked first and restrict the orders, and those the lines,
    by semi joins, before anything is combined.
    """
    clients = customer.where(which)
    own = orders.join(clients.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = lineitem.join(own.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return client_360(clients, own, lines)
