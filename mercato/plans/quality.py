"""Data-quality jobs (Q1-Q12, C33): profiles, integrity and constraint reports,
cleaning diagnostics.  Each returns a small long-format table; the work is
anti-joins and aggregates over the full tables, nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from mercato.functions.numeric import round_ratio
from mercato.params import Params
from mercato.plans.clean import in_box
from mercato.sources.lens import Raw
from mercato.sources.star import Star

RAW_TABLES = ("orders", "items", "payments", "reviews", "customers", "sellers", "products", "geolocation",
              "translation")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, 1)).cast("long")


# ------------------------------------------------------------ Q1 profile
def profile_table(name: str, df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, duplicate rows, and per column type, nulls / null % / distinct values.

    The distinct values are exact in two levels: narrow (column, value) pairs
    are counted map-side, then the counts of each column are added up, so a
    wide row is never multiplied by the number of columns.  `approx=True`
    switches to HyperLogLog for very wide or huge tables."""
    cols = df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if approx:
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[_cnt(F.col(c).isNull()).alias(f"n:{c}") for c in cols],
                      *[F.approx_count_distinct(c).alias(f"d:{c}") for c in cols])
    else:
        pairs = ", ".join(f"{i}, cast({'`%s` + 0' % c if isinstance(kinds[c], FractionalType) else '`%s`' % c} as string)"
                          for i, c in enumerate(cols))  # + 0 makes the two zeros of a double one
        counts = df.selectExpr(f"stack({len(cols)}, {pairs}) as (_c, _v)").groupBy("_c", "_v").agg(
            F.count(F.lit(1)).alias("_n"))
        per = counts.groupBy("_c").agg(F.sum("_n").alias("r"), F.sum(F.when(F.col("_v").isNull(), F.col("_n"))).alias("n"),
                                       F.count("_v").alias("d"))

        def of(i: int, what: str) -> Column:
            return F.coalesce(F.max(F.when(F.col("_c") == i, F.col(what))), F.lit(0))

        wide = per.agg(of(0, "r").alias("_rows"), *[of(i, "n").alias(f"n:{c}") for i, c in enumerate(cols)],
                       *[of(i, "d").alias(f"d:{c}") for i, c in enumerate(cols)])
    dups = df.groupBy(*cols).count().agg(F.sum(F.col("count") - 1).alias("_dups"))
    stack = ", ".join(f"'{c}', '{kinds[c].simpleString()}', `n:{c}`, `d:{c}`" for c in cols)
    base = wide.selectExpr("_rows", f"stack({len(cols)}, {stack}) as (column_name, dtype, nulls, distinct_values)")
    # the duplicate count is a single value: a scalar subquery, not a join
    dup_scalar = dups.select(F.coalesce("_dups", F.lit(0)).cast("long")).scalar()
    return base.select(
        F.lit(name).alias("table_name"),
        "column_name",
        "dtype",
        F.col("_rows").cast("long").alias("rows"),
        F.lit(len(cols)).cast("int").alias("columns"),
        dup_scalar.alias("duplicate_rows"),
        F.col("nulls").cast("long").alias("nulls"),
        round_ratio(F.col("nulls") * 100, "_rows", 2).alias("null_pct"),
        F.col("distinct_values").cast("long").alias("distinct_values"),
    )


def profile_tables(raw: Raw) -> DataFrame:
    return _union([profile_table(n, getattr(raw, n)) for n in RAW_TABLES])


def profile_schema(raw: Raw) -> DataFrame:
    """Column types per raw table (dtype part of the profile)."""
    spark = raw.orders.sparkSession
    rows = [(n, f.name, f.dataType.simpleString()) for n in RAW_TABLES for f in getattr(raw, n).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, dtype string")


# ------------------------------------------------------------ Q2 key integrity, Q4 ghost orders
def key_integrity(raw: Raw) -> DataFrame:
    o, i, pay, rev = raw.orders, raw.items, raw.payments, raw.reviews
    c, s, pr, tr = raw.customers, raw.sellers, raw.products, raw.translation

    def n(df: DataFrame, relation: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("long").alias("orphans")).select(
            F.lit(relation).alias("relation"), "orphans")

    def anti(child, parent, ck, pk=None):
        pk = pk or ck
        return child.join(parent.select(F.col(pk).alias("_pk")), F.col(ck) == F.col("_pk"), "left_anti")

    return _union([
        n(anti(o, c, "customer_id"), "orders -> customers"),
        n(anti(i, o, "order_id"), "order_items -> orders"),
        n(anti(i, pr, "product_id"), "order_items -> products"),
        n(anti(i, s, "seller_id"), "order_items -> sellers"),
        n(anti(pay, o, "order_id"), "payments -> orders"),
        n(anti(rev, o, "order_id"), "reviews -> orders"),
        n(anti(o, i, "order_id"), "orders without items"),
        n(anti(o, pay, "order_id"), "orders without payments"),
        n(anti(pr.filter(F.col("product_category_name").isNotNull()), tr, "product_category_name"),
          "products without English category"),
    ])


def ghost_orders(raw: Raw) -> DataFrame:
    ghosts = raw.orders.join(raw.items.select("order_id"), "order_id", "left_anti")
    return ghosts.groupBy("order_status").agg(F.count(F.lit(1)).cast("long").alias("orders"))


def unmapped_categories(raw: Raw) -> DataFrame:
    cats = raw.products.filter(F.col("product_category_name").isNotNull()).select("product_category_name")
    return cats.join(raw.translation, "product_category_name", "left_anti").groupBy("product_category_name").agg(
        F.count(F.lit(1)).cast("long").alias("products"))


# ------------------------------------------------------------ Q3 constraints on the star
PRIMARY_KEYS = {
    "dim_customers": ["customer_id"], "dim_sellers": ["seller_id"], "dim_products": ["product_id"],
    "dim_geolocation": ["zip_code_prefix"], "fact_orders": ["order_id"],
    "fact_order_items": ["order_id", "order_item_id"], "bridge_payments": ["order_id"],
    "bridge_reviews": ["review_id"],
}


def constraint_violations(s: Star) -> DataFrame:
    """Rows that break a key, NOT NULL, CHECK or foreign key rule, per rule.

    One grouping by the key gives all rules of a table; the children of one
    parent column are counted against it together."""
    checks = {
        "dim_customers": [("not null customer_unique_id", F.col("customer_unique_id").isNull())],
        "bridge_reviews": [("check review_score between 1 and 5", ~F.col("review_score").between(1, 5))],
    }
    parts = []
    for table, keys in PRIMARY_KEYS.items():
        rules = checks.get(table, [])
        per_key = getattr(s, table).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(rules)])
        wide = per_key.agg(
            F.sum(F.col("n") - 1).alias("dups"),
            *[F.sum(F.when(F.col(k).isNull(), F.col("n"))).alias(f"null_{k}") for k in keys],
            *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))])
        named = [("primary key " + ",".join(keys), "dups"), *[(f"not null {k}", f"null_{k}") for k in keys],
                 *[(name, f"c{i}") for i, (name, _) in enumerate(rules)]]
        parts.append(_unpivoted(wide, named).select(F.lit(table).alias("table_name"), "constraint_name", "violations"))

    def foreign(column: str, parent: str, children: list[str]) -> DataFrame:
        keys = _union([getattr(s, c).select(F.lit(c).alias("table_name"), F.col(column).alias("k")) for c in children])
        wanted = keys.filter(F.col("k").isNotNull()).groupBy("table_name", "k").agg(F.count(F.lit(1)).alias("n"))
        orphans = wanted.join(getattr(s, parent).select(F.col(column).alias("k")), "k", "left_anti")
        wide = orphans.agg(*[F.sum(F.when(F.col("table_name") == c, F.col("n"))).alias(c) for c in children])
        names = ", ".join(f"'{c}', `{c}`" for c in children)
        return wide.selectExpr(f"stack({len(children)}, {names}) as (table_name, v)").select(
            "table_name", F.lit(f"foreign key {column}").alias("constraint_name"),
            F.coalesce("v", F.lit(0)).cast("long").alias("violations"))

    parts += [
        foreign("customer_id", "dim_customers", ["fact_orders"]),
        foreign("order_id", "fact_orders", ["fact_order_items", "bridge_payments", "bridge_reviews"]),
        foreign("product_id", "dim_products", ["fact_order_items"]),
        foreign("seller_id", "dim_sellers", ["fact_order_items"]),
    ]
    return _union(parts)


def _unpivoted(wide: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    """(constraint_name, violations) from the columns of a one-row frame; NULL counts as 0."""
    pairs = ", ".join(f"'{name}', `{col}`" for name, col in named)
    return wide.selectExpr(f"stack({len(named)}, {pairs}) as (constraint_name, v)").select(
        "constraint_name", F.coalesce("v", F.lit(0)).cast("long").alias("violations"))


# ------------------------------------------------------------ Q9 row counts
def row_count_report(expected: Star, loaded: Star) -> DataFrame:
    """Expected (cleaned frames) vs loaded (star as stored) row counts."""
    parts = []
    for name in expected.tables():
        e = expected.tables()[name].agg(F.count(F.lit(1)).alias("e"))
        l_ = loaded.tables()[name].agg(F.count(F.lit(1)).alias("l"))
        parts.append(e.select("e", l_.scalar().alias("l")).select(
            F.lit(name).alias("table_name"), F.col("e").cast("long").alias("expected"),
            F.col("l").cast("long").alias("loaded"),
            F.when(F.col("e") == F.col("l"), "OK").otherwise("MISMATCH").alias("status")))
    return _union(parts)


# ------------------------------------------------------------ Q5 duplicates
def duplicate_review_rows(raw: Raw) -> DataFrame:
    """Every row of a review id that occurs more than once (keep=False)."""
    return raw.reviews.join(duplicate_review_ids(raw).select("review_id"), "review_id", "left_semi")


def duplicate_review_ids(raw: Raw) -> DataFrame:
    """Review ids that occur more than once, with their number of rows."""
    return raw.reviews.groupBy("review_id").agg(F.count(F.lit(1)).cast("long").alias("copies")).filter(
        F.col("copies") > 1)


def zip_prefix_stats(raw: Raw) -> DataFrame:
    per_zip = raw.geolocation.groupBy("geolocation_zip_code_prefix").agg(F.count(F.lit(1)).alias("n"))
    return per_zip.agg(
        F.count(F.lit(1)).cast("long").alias("unique_zip_prefixes"),
        F.sum("n").cast("long").alias("total_rows"),
        round_ratio(F.sum("n"), F.count(F.lit(1)), 1).alias("avg_rows_per_prefix"),
        F.max("n").cast("long").alias("max_rows_per_prefix"),
    )


def items_per_order(raw: Raw) -> DataFrame:
    """Distribution of the highest item number per order."""
    per = raw.items.groupBy("order_id").agg(F.max("order_item_id").alias("items"))
    return per.groupBy("items").agg(F.count(F.lit(1)).cast("long").alias("orders"))


# ------------------------------------------------------------ Q6 geolocation outliers
def geo_outliers(raw: Raw, p: Params) -> DataFrame:
    g = raw.geolocation
    out = g.filter(~in_box("geolocation_lat", "geolocation_lng", p.profile_box_lat, p.profile_box_lng))
    return out.agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.min("geolocation_lat").alias("lat_min"), F.max("geolocation_lat").alias("lat_max"),
        F.min("geolocation_lng").alias("lng_min"), F.max("geolocation_lng").alias("lng_max"),
    )


# ------------------------------------------------------------ Q7 / Q8 delivery diagnostics
def delivery_anomalies(raw: Raw, s: Star, p: Params) -> DataFrame:
    """Negative, very long and same-day delivery times (before/after cleaning)."""
    from mercato.functions.timefx import floor_days

    d = floor_days("order_purchase_timestamp", "order_delivered_customer_date")
    r = raw.orders.agg(
        _cnt(d < 0).alias("negative_days_raw"),
        _cnt(d > p.max_delivery_days).alias("over_max_days_raw"),
    )
    c = s.fact_orders.agg(
        _cnt(F.col("days_to_deliver") < 0).alias("negative_days_clean"),
        _cnt(F.col("days_to_deliver") > p.max_delivery_days).alias("over_max_days_clean"),
        _cnt(F.col("days_to_deliver") == 0).alias("same_day"),
    )
    return r.select("*", *[c.select(n).scalar().alias(n) for n in c.columns])


def long_deliveries(s: Star, p: Params) -> DataFrame:
    return s.fact_orders.filter(F.col("days_to_deliver") > p.max_delivery_days).select(
        "order_id", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date", "days_to_deliver", "days_vs_estimate",
        "is_late")


def placeholder_report(s: Star, p: Params) -> DataFrame:
    """Placeholder-date detection and the null-breakdown reconciliation."""
    fo = s.fact_orders
    delivered = F.col("order_status") == p.delivered_status
    per_date = [
        fo.agg(_cnt(delivered & (F.to_date("order_delivered_customer_date") == F.lit(d))).alias("value")).select(
            F.lit(f"delivered_on_{d.isoformat()}").alias("metric"), "value")
        for d in p.placeholder_dates
    ]
    clean = delivered & ~F.col("has_placeholder_delivery_date") & F.col("is_late").isNotNull()
    tot = fo.agg(
        _cnt(F.col("has_placeholder_delivery_date")).alias("placeholder_orders"),
        _cnt(F.col("order_delivered_customer_date").isNull()).alias("no_delivery_date"),
        _cnt(F.col("days_to_deliver").isNull()).alias("days_to_deliver_nulls"),
        _cnt(F.col("days_vs_estimate").isNull()).alias("days_vs_estimate_nulls"),
        _cnt(F.col("is_late").isNull()).alias("is_late_nulls"),
        _cnt(clean).alias("clean_delivered"),
        _cnt(clean & F.col("is_late")).alias("clean_late"),
    )
    names = tot.columns
    stacked = tot.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names)
                             + ") as (metric, value)")
    return _union(per_date + [stacked]).select("metric", F.col("value").cast("long").alias("value"))


# ------------------------------------------------------------ Q11 before/after per cleaning step
def cleaning_steps(raw: Raw, s: Star, p: Params) -> DataFrame:
    """One row per (step, metric) with the value before and after the step.

    Every stage of the cleaning is counted by one aggregate, whose figures are
    the 'after' of one step and the 'before' of the next."""
    dims = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    rows = F.count(F.lit(1))
    kept = ~F.col("payment_type").eqNullSafe(p.not_defined_payment)

    def nulls(c: str) -> Column:
        return F.count_if(F.col(c).isNull())

    def figures(df: DataFrame, *entries: tuple[Column, list[tuple[str, str, str]]]) -> DataFrame:
        """Rows (step, metric, side, value); an entry is a figure and where it goes."""
        wide = df.agg(*[c.cast("long").alias(f"f{i}") for i, (c, _) in enumerate(entries)])
        out = [f"'{step}', '{metric}', '{side}', `f{i}`" for i, (_, to) in enumerate(entries) for step, metric, side in to]
        return wide.selectExpr(f"stack({len(out)}, {', '.join(out)}) as (step, metric, side, value)")

    dup, box, one = "rows: exact duplicates dropped", "rows: outside box dropped", "rows: one per zip prefix"
    rev, undefined, per_order = "rows: duplicate review ids dropped", "rows: not_defined dropped", "rows: one per order"
    g = "geolocation"
    english = ("products", "english name nulls")
    named = raw.products.join(raw.translation, "product_category_name", "left")
    parts = [
        figures(raw.geolocation, (rows, [(g, dup, "before")])),
        figures(raw.geolocation.distinct(), (rows, [(g, dup, "after"), (g, box, "before")]),
                (F.count_if(in_box("geolocation_lat", "geolocation_lng", p.box_lat, p.box_lng)),
                 [(g, box, "after"), (g, one, "before")])),
        figures(s.dim_geolocation, (rows, [(g, one, "after")])),
        figures(raw.reviews, (rows, [("reviews", rev, "before")])),
        figures(s.bridge_reviews, (rows, [("reviews", rev, "after")])),
        figures(raw.payments, (rows, [("payments", undefined, "before")]),
                (F.count_if(kept), [("payments", undefined, "after"), ("payments", per_order, "before")])),
        figures(s.bridge_payments, (rows, [("payments", per_order, "after")])),
        figures(named, (nulls("product_category_name_english"), [(*english, "before")])),
        figures(raw.products, *[(nulls(c), [("products", f"{c} nulls", "before")]) for c in dims]),
        figures(s.dim_products, (nulls("product_category_name_english"), [(*english, "after")]),
                *[(nulls(c), [("products", f"{c} nulls", "after")]) for c in dims]),
    ]
    return _union(parts).groupBy("step", "metric").agg(
        F.max(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
        F.max(F.when(F.col("side") == "after", F.col("value"))).alias("after"))


# ------------------------------------------------------------ Q10 extract reconciliation
def extract_reconciliation(rfm: DataFrame, unified: DataFrame) -> DataFrame:
    """Segment sizes in two extracts (the RFM view and the unified table) and the
    sizes of their differences, via one full outer join on (person, segment)."""
    a = rfm.select("customer_unique_id", "segment").distinct().withColumn("in_a", F.lit(True))
    b = unified.filter(F.col("segment").isNotNull()).select("customer_unique_id", "segment").distinct() \
        .withColumn("in_b", F.lit(True))
    j = a.join(b, ["customer_unique_id", "segment"], "full")
    ia, ib = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return j.groupBy("segment").agg(
        _cnt(ia).alias("view_customers"),
        _cnt(ib).alias("unified_customers"),
        _cnt(ia & ~ib).alias("in_view_not_unified"),
        _cnt(ib & ~ia).alias("in_unified_not_view"),
    )


def extract_difference_sample(rfm: DataFrame, unified: DataFrame, n: int = 20) -> DataFrame:
    """Sample rows of the reconciliation: the first ``n`` (person, segment) pairs
    that stand in only one of the two extracts."""
    a = rfm.select("customer_unique_id", "segment").distinct().withColumn("in_a", F.lit(True))
    b = unified.filter(F.col("segment").isNotNull()).select("customer_unique_id", "segment").distinct() \
        .withColumn("in_b", F.lit(True))
    j = a.join(b, ["customer_unique_id", "segment"], "full").filter(F.col("in_a").isNull() | F.col("in_b").isNull())
    side = F.when(F.col("in_b").isNull(), "view").otherwise("unified")
    return j.select("customer_unique_id", "segment", side.alias("only_in")).orderBy("customer_unique_id", "segment").limit(n)
