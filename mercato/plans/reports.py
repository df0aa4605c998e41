"""Validation queries, chart data, dashboard sheets and operational extracts
built on top of the views (C8, C10-C11, C13, C15, C17-C18, C20, C23-C25,
C27-C30).  All inputs here are already aggregated (one row per category,
seller, month, segment...), so the small global windows below run over
bounded frames; the only order-grain inputs (delay drivers, unified table)
are reduced with partial aggregates or a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.hashing import id_bits
from mercato.functions.numeric import round_ratio, unscaled
from mercato.operators.comoments import correlations
from mercato.operators.prefix import exact_quantiles
from mercato.operators.ranking import top_n
from mercato.params import Params


def avg_round(col, scale: int, digits: int) -> Column:
    """ROUND(AVG(x), digits) for values with `scale` decimals, exact."""
    c = F.col(col) if isinstance(col, str) else col
    return round_ratio(F.sum(unscaled(c, scale)), F.count(c) * (10**scale), digits)


def sum_round(col, scale: int, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return round_ratio(F.sum(unscaled(c, scale)), F.lit(10**scale), digits)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1)).cast("long")


def title_words(c: Column) -> Column:
    """str.replace('_', ' ').str.title() for the display names."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def pg_avg(col, digits: int) -> Column:
    """ROUND(AVG(integer column), digits) exact."""
    return round_ratio(F.sum(col), F.count(col), digits)


# ------------------------------------------------------------ RFM (1A, 1B)
def rfm_validation(rfm: DataFrame) -> DataFrame:
    return rfm.agg(
        F.count(F.lit(1)).cast("long").alias("total_customers"),
        count_if(F.col("segment").isNull()).alias("null_segments"),
        count_if(F.col("monetary") <= 0).alias("zero_monetary"),
        F.min("recency_days").alias("min_recency"),
        F.max("recency_days").alias("max_recency"),
    )


# ------------------------------------------------------------ cohorts (2A-2D, chart 2)
def _cohort_kept(cr: DataFrame, p: Params) -> DataFrame:
    return cr.filter(~F.col("cohort_month").isin([F.lit(d) for d in p.cohort_exclude]))


def cohort_matrix(cr: DataFrame, p: Params) -> DataFrame:
    """Wide cohort x period matrix (pivot), labelled 'Mon yyyy', with a column
    for every month that a cohort can have reached by the reference date."""
    kept = _cohort_kept(cr, p)
    return (
        kept.groupBy("cohort_month", F.date_format("cohort_month", "MMM yyyy").alias("cohort_label"))
        .pivot("period_number", list(range(p.cohort_periods())))
        .agg(F.max("retention_rate_pct"))
    )


def cohort_shape(cr: DataFrame) -> DataFrame:
    return cr.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count_distinct("cohort_month").cast("long").alias("cohort_count"),
        F.max("period_number").alias("max_period"),
        F.min("retention_rate_pct").alias("min_retention"),
        F.max("retention_rate_pct").alias("max_retention"),
    )


def cohort_dropoff(cr: DataFrame) -> DataFrame:
    return cr.filter(F.col("period_number") <= 6).groupBy("period_number").agg(
        avg_round("retention_rate_pct", 2, 2).alias("avg_retention_pct"),
        F.max("retention_rate_pct").alias("max_retention_pct"),
    )


def cohort_best_period1(cr: DataFrame) -> DataFrame:
    x = cr.filter((F.col("period_number") == 1) & (F.col("cohort_size") > 10)).select(
        "cohort_month", "cohort_size", "active_customers", "retention_rate_pct"
    )
    return top_n(x, 10, [F.col("retention_rate_pct").desc(), F.col("cohort_month").asc()])


def cohort_summary(cr: DataFrame, p: Params) -> DataFrame:
    x = _cohort_kept(cr, p).filter(F.col("period_number") > 0)
    return x.agg(
        F.count_distinct("cohort_month").cast("long").alias("cohorts"),
        F.max("retention_rate_pct").alias("max_retention"),
    )


# ------------------------------------------------------------ category SLA (3A, 3B, chart 4, chart 5)
def category_sla_summary(sla: DataFrame) -> DataFrame:
    return sla.agg(
        F.count(F.lit(1)).cast("long").alias("total_categories"),
        F.sum("total_orders").cast("long").alias("total_orders_covered"),
        avg_round("late_rate_pct", 2, 2).alias("avg_late_rate"),
        F.max("late_rate_pct").alias("worst_category_rate"),
        F.min("late_rate_pct").alias("best_category_rate"),
        count_if(F.col("sla_tier") == "Critical").alias("critical_count"),
        count_if(F.col("sla_tier") == "Below Average").alias("below_avg_count"),
    )


def category_sla_worst10(sla: DataFrame) -> DataFrame:
    x = sla.select("product_category_name", "total_orders", "late_rate_pct", "avg_days_to_deliver",
                   "p90_days_to_deliver", "sla_tier")
    return top_n(x, 10, [F.col("late_rate_pct").desc(), F.col("product_category_name").asc()])


def category_sla_top15(sla: DataFrame, p: Params) -> DataFrame:
    x = sla.filter(F.col("total_orders") >= p.sla_min_orders).select(
        "product_category_name", "total_orders", "late_rate_pct", "avg_days_to_deliver",
        "p90_days_to_deliver", "sla_tier", title_words(F.col("product_category_name")).alias("category_display"),
    )
    return top_n(x, 15, [F.col("late_rate_pct").desc(), F.col("product_category_name").asc()])


def revenue_vs_late(sla: DataFrame, rev: DataFrame, p: Params) -> DataFrame:
    """Chart 5: categories with enough orders, their revenue, quadrant flags
    (against the medians of the plotted set), bubble size, top-8 labels."""
    cats = sla.filter(F.col("total_orders") >= p.revenue_vs_late_min_orders).select(
        "product_category_name", "total_orders", "late_rate_pct", "avg_days_to_deliver", "sla_tier"
    )
    r = rev.groupBy("product_category_name").agg(F.sum(unscaled("total_revenue", 2)).alias("rev_c"))
    x = cats.join(r, "product_category_name", "left")
    every = Window.partitionBy()  # over the plotted categories only: a few hundred rows
    med_late = F.percentile("late_rate_pct", 0.5).over(every)
    med_rev = F.percentile(F.col("rev_c") / 100.0, 0.5).over(every)
    top = F.row_number().over(Window.orderBy(F.col("rev_c").desc_nulls_last(), F.col("product_category_name")))
    return x.select(
        "product_category_name", "total_orders", "late_rate_pct", "avg_days_to_deliver", "sla_tier",
        (F.col("rev_c") / 100.0).alias("total_revenue"),
        F.round(F.col("total_orders") / F.max("total_orders").over(every) * 1200 + 40, 4).alias("bubble_size"),
        (F.col("late_rate_pct") >= med_late).alias("above_median_late"),
        ((F.col("rev_c") / 100.0) >= med_rev).alias("above_median_revenue"),
        (top <= 8).alias("is_top8_revenue"),
    )


# ------------------------------------------------------------ sellers (4A-4C, chart 6)
def seller_sanity(sp: DataFrame) -> DataFrame:
    return sp.agg(
        F.count(F.lit(1)).cast("long").alias("total_sellers"),
        sum_round("total_revenue", 2, 0).alias("platform_revenue"),
        avg_round("late_rate_pct", 2, 2).alias("avg_seller_late_rate"),
        count_if(F.col("seller_risk_tier") == "High Risk").alias("high_risk_sellers"),
        count_if(F.col("seller_risk_tier") == "Strong Performer").alias("strong_sellers"),
        F.min("avg_review_score").alias("min_review_score"),
        F.max("avg_review_score").alias("max_review_score"),
    )


def seller_top_revenue(sp: DataFrame) -> DataFrame:
    x = sp.select("seller_id", "seller_state", "total_orders", "total_revenue", "late_rate_pct",
                  "avg_review_score", "seller_risk_tier")
    return top_n(x, 10, [F.col("total_revenue").desc(), F.col("seller_id").asc()])


def seller_high_risk(sp: DataFrame) -> DataFrame:
    x = sp.filter(F.col("seller_risk_tier") == "High Risk").select(
        "seller_id", "seller_state", "total_orders", "late_rate_pct", "avg_days_to_deliver",
        "avg_review_score", "seller_risk_tier")
    return top_n(x, 10, [F.col("late_rate_pct").desc(), F.col("seller_id").asc()])


TIER_ORDER = ["High Risk", "Elevated Risk", "Average", "Strong Performer"]  # fixed values: chart order


def seller_risk_tiers(sp: DataFrame, p: Params) -> DataFrame:
    """Chart 6 in the fixed tier order; tiers without sellers stay as NULL rows."""
    g = sp.filter(F.col("total_orders") >= p.seller_min_orders).groupBy("seller_risk_tier").agg(
        F.count(F.lit(1)).cast("long").alias("seller_count"),
        sum_round("total_revenue", 2, 0).alias("total_revenue"),
        avg_round("late_rate_pct", 2, 2).alias("avg_late_rate"),
        avg_round("avg_review_score", 2, 3).alias("avg_review_score"),
    )
    order = sp.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("seller_risk_tier"), F.lit(i + 1).alias("tier_order"))
                           for i, t in enumerate(TIER_ORDER)]))
    )
    # like the reindexed chart frame, the count is NaN-able: emitted as double
    return order.join(g, "seller_risk_tier", "left").withColumn("seller_count", F.col("seller_count").cast("double"))


# ------------------------------------------------------------ revenue (6A-6C, chart 3)
def revenue_shape(rev: DataFrame) -> DataFrame:
    return rev.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count_distinct("order_month").cast("long").alias("months_covered"),
        F.count_distinct("product_category_name").cast("long").alias("categories_covered"),
        sum_round("total_revenue", 2, 0).alias("sum_of_category_revenue"),
    )


def revenue_top5(rev: DataFrame) -> DataFrame:
    g = rev.groupBy("product_category_name").agg(
        F.sum("total_orders").cast("long").alias("total_orders"),
        sum_round("total_revenue", 2, 0).alias("total_revenue"),
        avg_round("revenue_share_pct", 2, 2).alias("avg_monthly_share_pct"),
    )
    return top_n(g, 5, [F.col("total_revenue").desc(), F.col("product_category_name").asc()])


def _monthly(rev: DataFrame) -> DataFrame:
    return rev.groupBy("order_month").agg(
        F.sum(unscaled("total_revenue", 2)).alias("rev_c"),
        F.sum("total_orders").cast("long").alias("total_orders"),
    )


def revenue_peak_months(rev: DataFrame) -> DataFrame:
    m = _monthly(rev).select(
        "order_month",
        round_ratio("rev_c", F.lit(100), 0).alias("monthly_revenue"),
        F.col("total_orders").alias("monthly_orders"),
    )
    return top_n(m, 5, [F.col("monthly_revenue").desc(), F.col("order_month").asc()])


def revenue_trend(rev: DataFrame) -> DataFrame:
    return _monthly(rev).select("order_month", (F.col("rev_c") / 100.0).alias("total_revenue"), "total_orders")


def revenue_summary(rev: DataFrame) -> DataFrame:
    m = _monthly(rev)
    return m.agg(
        F.count(F.lit(1)).cast("long").alias("months"),
        F.min_by("order_month", F.struct(-F.col("rev_c"), F.col("order_month"))).alias("peak_month"),
        (F.max("rev_c") / 100.0).alias("peak_revenue"),
        (F.sum("rev_c") / 100.0).alias("total_revenue"),
    )


# ------------------------------------------------------------ cancellations (5A-5C, chart 7)
def cancellation_by_dimension(ca: DataFrame) -> DataFrame:
    return ca.groupBy("analysis_dimension").agg(
        F.count(F.lit(1)).cast("long").alias("dimension_rows"),
        avg_round("cancel_rate_pct", 2, 2).alias("avg_cancel_rate"),
        F.min("cancel_rate_pct").alias("min_cancel_rate"),
        F.max("cancel_rate_pct").alias("max_cancel_rate"),
    )


def cancellation_platform_rate(ca: DataFrame) -> DataFrame:
    m = ca.filter(F.col("analysis_dimension") == "monthly")
    g = m.agg(F.sum("cancelled_orders").alias("c"), F.sum("total_orders").alias("t"))
    return g.select(
        F.col("c").cast("long").alias("total_cancelled"),
        F.col("t").cast("long").alias("total_orders"),
        round_ratio(F.col("c") * 100, "t", 2).alias("platform_cancel_rate"),
    )


def cancellation_hotspots(ca: DataFrame) -> DataFrame:
    x = ca.filter(F.col("analysis_dimension").isin("state", "category") & (F.col("cancel_rate_pct") > 5)).select(
        "analysis_dimension", "dimension_value", "total_orders", "cancel_rate_pct")
    return top_n(x, 20, [F.col("analysis_dimension").asc(), F.col("cancel_rate_pct").desc(),
                         F.col("dimension_value").asc()])


def cancellation_monthly(ca: DataFrame, p: Params) -> DataFrame:
    excl = [d.isoformat() for d in p.cancel_exclude_months]
    m = ca.filter((F.col("analysis_dimension") == "monthly") & ~F.col("dimension_value").isin(excl))
    return m.select(
        F.to_date("dimension_value").alias("order_month"), "total_orders", "cancelled_orders", "cancel_rate_pct"
    )


def cancellation_top_states(ca: DataFrame, p: Params) -> DataFrame:
    x = ca.filter((F.col("analysis_dimension") == "state") & (F.col("total_orders") >= p.cancel_min_orders_state))
    x = x.select(F.col("dimension_value").alias("state"), "total_orders", "cancelled_orders", "cancel_rate_pct")
    return top_n(x, 15, [F.col("cancel_rate_pct").desc(), F.col("state").asc()])


# ------------------------------------------------------------ delay drivers (7A, 7B, chart 8, class split)
def delay_feature_balance(dd: DataFrame) -> DataFrame:
    g = dd.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("is_late"), 1).otherwise(0)).alias("late"),
        count_if(F.col("avg_product_weight_g").isNull()).alias("null_weight"),
        count_if(F.col("seller_hist_late_rate").isNull()).alias("null_seller_rate"),
        count_if(F.col("approval_lag_hours").isNull()).alias("null_approval_lag"),
    )
    return g.select(
        F.col("n").cast("long").alias("total_orders"),
        F.col("late").cast("long").alias("late_orders"),
        round_ratio(F.col("late") * 100, "n", 2).alias("late_rate_pct"),
        "null_weight", "null_seller_rate", "null_approval_lag",
    )


def delay_feature_sanity(dd: DataFrame) -> DataFrame:
    return dd.agg(
        pg_avg(F.col("item_count"), 2).alias("avg_items"),
        avg_round("order_value", 2, 2).alias("avg_order_value"),
        avg_round("avg_product_weight_g", 1, 1).alias("avg_weight_g"),
        avg_round("seller_hist_late_rate", 2, 2).alias("avg_seller_late_rate"),
        avg_round("approval_lag_hours", 2, 1).alias("avg_approval_lag_hrs"),
        F.count_distinct("customer_state").cast("long").alias("distinct_states"),
        F.count_distinct("primary_category").cast("long").alias("distinct_categories"),
    )


def class_split(dd: DataFrame) -> DataFrame:
    g = dd.groupBy("is_late").agg(F.count(F.lit(1)).cast("long").alias("orders"))
    total = F.sum("orders").over(Window.partitionBy())  # 2-3 rows
    return g.select("is_late", "orders", round_ratio(F.col("orders") * 100, total, 2).alias("pct"))


def delay_outcome_means(dd: DataFrame) -> DataFrame:
    x = dd.filter(F.col("approval_lag_hours").isNotNull())
    late, ontime = F.col("is_late"), ~F.col("is_late")
    return x.agg(
        avg_round(F.when(late, F.col("seller_hist_late_rate")), 2, 2).alias("late_seller_rate"),
        avg_round(F.when(ontime, F.col("seller_hist_late_rate")), 2, 2).alias("ontime_seller_rate"),
        avg_round(F.when(late, F.col("approval_lag_hours")), 2, 2).alias("late_lag"),
        avg_round(F.when(ontime, F.col("approval_lag_hours")), 2, 2).alias("ontime_lag"),
    )


def delay_driver_rows(dd: DataFrame, p: Params) -> DataFrame:
    """The orders that chart 8 is about."""
    return dd.filter(
        F.col("approval_lag_hours").isNotNull()
        & (F.col("approval_lag_hours") <= p.sample_max_lag_hours)
        & F.col("seller_hist_late_rate").isNotNull()
    ).select("order_id", "is_late", "approval_lag_hours", "item_count", "order_value", "freight_ratio_pct",
             "seller_hist_late_rate", "seller_avg_days_to_deliver", "customer_state")


def delay_driver_sample(dd: DataFrame, p: Params) -> DataFrame:
    """A repeatable uniform sample, the orders with the smallest salted hash."""
    key = id_bits("order_id", f"sample{p.sample_seed}")
    return delay_driver_rows(dd, p).withColumn("_k", key).orderBy("_k", "order_id").limit(p.sample_size).drop("_k")


def delay_by_outcome(rows: DataFrame) -> DataFrame:
    """Chart 8 box statistics per outcome for the two features (long format),
    over all of ``rows``."""
    outcome = F.when(F.col("is_late"), "Late").otherwise("On Time")
    parts = []
    for feat in ("approval_lag_hours", "seller_hist_late_rate"):
        x = rows.select(outcome.alias("outcome"), F.col(feat).alias("v"))
        q = exact_quantiles(x, "v", [0.25, 0.5, 0.75], ["outcome"]).select(
            "outcome", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
        q = q.join(x.groupBy("outcome").agg(F.count("v").cast("long").alias("n"), avg_round("v", 2, 2).alias("mean")),
                   "outcome")
        iqr = F.col("q3") - F.col("q1")
        lo, hi = F.col("q1") - iqr * 1.5, F.col("q3") + iqr * 1.5
        w = x.join(q.select("outcome", "q1", "q3"), "outcome").groupBy("outcome").agg(
            F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
            F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"),
            count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("outliers"),
        )
        parts.append(q.join(w, "outcome").select(
            F.lit(feat).alias("feature"), "outcome", "n", "mean",
            F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), F.round("q3", 4).alias("q3"),
            "whisker_low", "whisker_high", "outliers"))
    return parts[0].unionByName(parts[1])


# fixed values: the features of the matrix, whose order makes the lower triangle
CORR_FEATURES = [
    "is_late", "item_count", "seller_count", "order_value", "freight_value", "avg_item_price",
    "freight_ratio_pct", "avg_product_weight_g", "avg_product_volume_cm3", "seller_hist_late_rate",
    "seller_avg_days_to_deliver", "seller_total_orders", "approval_lag_hours", "order_hour", "order_month_num",
]


def feature_correlation(dd: DataFrame) -> DataFrame:
    """Lower triangle of the Pearson matrix, from one matrix of co-moments."""
    x = dd.filter(F.col("approval_lag_hours").isNotNull()).select(
        *[F.col(c).cast("double").alias(c) for c in CORR_FEATURES])
    return correlations(x, CORR_FEATURES).select("feature_a", "feature_b", F.round("r", 6).alias("r"))


def high_correlation_pairs(corr: DataFrame, p: Params) -> DataFrame:
    x = corr.filter((F.col("feature_a") != "is_late") & (F.col("feature_b") != "is_late"))
    return x.filter(F.abs("r") > p.corr_threshold).select("feature_a", "feature_b", F.round("r", 3).alias("r"))


# ------------------------------------------------------------ unified table checks
def unified_checks(u: DataFrame) -> DataFrame:
    """People per segment, unmatched rows, totals and non-zero null counts per column.

    The rows are read once, as two grouping sets: the (segment, person) pairs (a
    person has one segment) and the (segment, columns that are null) pairs, of
    which there are few.  No null counts are kept or shuffled per person."""
    nulls = {c: f"null_{i}" for i, c in enumerate(u.columns)}
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in nulls])
    pairs = u.select("segment", "customer_unique_id", missing.alias("_missing")).groupingSets(
        [["segment", "customer_unique_id"], ["segment", "_missing"]], "segment", "customer_unique_id", "_missing").agg(
        F.grouping_id().alias("_set"), F.sum(F.lit(1)).alias("_rows"))  # a bit for each column that is not grouped by
    of_person, rows = F.col("_set") == 1, F.when(F.col("_set") == 2, F.col("_rows")).otherwise(0)
    per_segment = pairs.groupBy("segment").agg(
        F.count(F.when(of_person, F.col("customer_unique_id"))).alias("people"), F.sum(rows).alias("rows"),
        *[F.sum(F.when(F.substring("_missing", i + 1, 1) == "1", rows).otherwise(0)).alias(n)
          for i, n in enumerate(nulls.values())])

    def figure(check: str, item: Column, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check_name"), item.alias("item"), value.cast("long").alias("value"))

    unmatched = F.when(F.col("segment").isNull(), F.col("rows")).otherwise(0)
    segment = F.coalesce("segment", F.lit("<none>"))
    figures = [figure("people_per_segment", segment, F.col("people")), figure("totals", F.lit("people"), F.col("people")),
               figure("totals", F.lit("rows"), F.col("rows")), figure("totals", F.lit("unmatched_rows"), unmatched),
               *[figure("nulls", F.lit(c), F.col(n)) for c, n in nulls.items()]]
    added = per_segment.select(F.explode(F.array(*figures)).alias("f")).groupBy("f.check_name", "f.item").agg(
        F.sum("f.value").cast("long").alias("value"))
    return added.filter((F.col("check_name") != "nulls") | (F.col("value") > 0))


# ------------------------------------------------------------ dashboards
def _segment_filtered(u: DataFrame, p: Params) -> DataFrame:
    return u if p.segment_filter is None else u.filter(F.col("segment") == p.segment_filter)


def dash_segments(u: DataFrame) -> DataFrame:
    return u.groupBy("segment").agg(
        F.count_distinct("customer_unique_id").cast("long").alias("customer_count"),
        F.count_distinct("order_id").cast("long").alias("orders"),
        (F.sum(unscaled(F.col("price") + F.col("freight_value"), 2)) / 100.0).alias("total_revenue"),
    )


def dash_revenue_top5(u: DataFrame, p: Params) -> DataFrame:
    """Revenue trend of the top 5 categories (by revenue under the segment filter):
    top-N on the category aggregate, then a semi-join back to the detail."""
    x = _segment_filtered(u, p).withColumn("rev_c", unscaled(F.col("price") + F.col("freight_value"), 2))
    tot = x.groupBy("product_category_name_english").agg(F.sum("rev_c").alias("t"))
    top5 = top_n(tot, 5, [F.col("t").desc(), F.col("product_category_name_english").asc()])
    d = x.join(top5.select("product_category_name_english"), "product_category_name_english", "left_semi")
    return d.groupBy("order_month", "product_category_name_english").agg(
        (F.sum("rev_c") / 100.0).alias("total_revenue"))


def dash_sla_top20(u: DataFrame, p: Params) -> DataFrame:
    x = _segment_filtered(u, p).filter(F.col("category_late_rate_pct").isNotNull())
    g = x.groupBy("product_category_name_english").agg(
        avg_round("category_late_rate_pct", 2, 4).alias("avg_category_late_rate_pct"),
        F.min("category_sla_tier").alias("category_sla_tier"),
    )
    return top_n(g, 20, [F.col("avg_category_late_rate_pct").desc(), F.col("product_category_name_english").asc()])


def dash_retention(cr: DataFrame, p: Params) -> DataFrame:
    return _cohort_kept(cr, p).select("cohort_month", "period_number", "retention_rate_pct")


def geo_drill(u: DataFrame) -> DataFrame:
    """Drill path state -> city -> total: orders are reduced to one row each
    first (an order has one customer), then rolled up with plain counts."""
    o = u.groupBy("order_id", "customer_state", "customer_city").agg(
        F.sum(unscaled(F.col("price") + F.col("freight_value"), 2)).alias("rev_c"),
        F.max(F.col("is_late").cast("int")).alias("late"),
    )
    g = o.rollup("customer_state", "customer_city").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).cast("long").alias("orders"),
        F.sum("rev_c").alias("rev_c"),
        F.sum(F.coalesce("late", F.lit(0))).alias("late"),
    )
    level = F.when(F.col("gid") == 0, "city").when(F.col("gid") == 1, "state").otherwise("total")
    return g.select(
        level.alias("level"), "customer_state", "customer_city", "orders",
        (F.col("rev_c") / 100.0).alias("total_revenue"),
        F.col("late").cast("long").alias("late_orders"),
        round_ratio(F.col("late") * 100, "orders", 2).alias("late_rate_pct"),
    )


# ------------------------------------------------------------ operational dashboard
def ops_seller_kpis(sp: DataFrame) -> DataFrame:
    return sp.agg(
        F.count(F.lit(1)).cast("long").alias("sellers"),
        avg_round("late_rate_pct", 2, 2).alias("avg_late_rate_pct"),
        (F.sum(unscaled("total_revenue", 2)) / 100.0).alias("total_revenue"),
        count_if(F.col("seller_risk_tier").isin("High Risk", "Elevated Risk")).alias("at_risk_sellers"),
    )


def ops_top20_sellers(sp: DataFrame) -> DataFrame:
    x = sp.select("seller_id", "seller_state", "total_orders", "late_rate_pct", "seller_risk_tier")
    return top_n(x, 20, [F.col("late_rate_pct").desc(), F.col("seller_id").asc()])


def ops_volume_vs_late(sp: DataFrame) -> DataFrame:
    n = F.col("total_orders")
    band = F.when(n >= 100, "100+").when(n >= 50, "50-99").when(n >= 20, "20-49").otherwise("10-19")
    return sp.groupBy(band.alias("volume_band")).agg(
        F.count(F.lit(1)).cast("long").alias("sellers"),
        avg_round("late_rate_pct", 2, 2).alias("avg_late_rate_pct"),
        F.sum("total_orders").cast("long").alias("orders"),
    )


def ops_cancel_trend(mc: DataFrame, p: Params) -> DataFrame:
    lo, hi = p.ops_cancel_start.isoformat()[:7], p.ops_cancel_end.isoformat()[:7]
    return mc.filter(F.col("order_month").between(lo, hi))


def ops_top15_categories(ca: DataFrame, products: DataFrame) -> DataFrame:
    names = products.select("product_category_name", "product_category_name_english").distinct()
    x = ca.filter(F.col("analysis_dimension") == "category").join(
        names, ca.dimension_value == names.product_category_name, "left")
    x = x.select(F.col("dimension_value").alias("product_category_name"), "product_category_name_english",
                 "total_orders", "cancelled_orders", "cancel_rate_pct")
    return top_n(x, 15, [F.col("cancel_rate_pct").desc(), F.col("product_category_name").asc()])


def ops_state_table(ca: DataFrame) -> DataFrame:
    return ca.filter(F.col("analysis_dimension") == "state").select(
        F.col("dimension_value").alias("state"), "total_orders", "cancelled_orders", "cancel_rate_pct")


# ------------------------------------------------------------ C32 sanity table
def eda_sanity(rfm, cr, rev, sla, sp, ca, dd, p: Params) -> DataFrame:
    """One row per published figure of the final EDA check: (metric, value,
    expected, result); a figure without an expectation is NOT SET.

    One aggregate per source view (seven scans of already-aggregated frames),
    each unpivoted with `stack`, instead of one job per figure."""
    def stacked(df: DataFrame, **metrics: Column) -> DataFrame:
        wide = df.agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
        pairs = ", ".join(f"'{k}', `{k}`" for k in metrics)
        return wide.selectExpr(f"stack({len(metrics)}, {pairs}) as (metric, value)")

    excl = [d.isoformat() for d in p.cancel_exclude_months]
    kept_cr = _cohort_kept(cr, p).filter(F.col("period_number") > 0)
    m = _monthly(rev)
    lagged = dd.filter(F.col("approval_lag_hours").isNotNull())
    late, ontime = F.col("is_late"), ~F.col("is_late")
    tier, n = F.col("sla_tier"), F.col("total_orders")
    dim = F.col("analysis_dimension")
    parts = [
        stacked(rfm, rfm_customers=F.count(F.lit(1)), rfm_revenue=sum_round("monetary", 2, 0)),
        stacked(kept_cr, cohorts=F.count_distinct("cohort_month"),
                max_retention_pct_after_period0=F.max("retention_rate_pct")),
        stacked(m, revenue_months=F.count(F.lit(1)),
                peak_month_revenue=round_ratio(F.max("rev_c"), F.lit(100), 0),
                total_revenue=round_ratio(F.sum("rev_c"), F.lit(100), 0)),
        stacked(sla, critical_categories=count_if((tier == "Critical") & (n >= p.sla_min_orders)),
                worst_category_late_rate_pct=F.max("late_rate_pct"),
                categories_min_orders_scatter=count_if(n >= p.revenue_vs_late_min_orders)),
        stacked(sp, sellers_min_orders=count_if(n >= p.seller_min_orders)),
        stacked(ca, max_monthly_cancel_rate_pct=F.max(F.when((dim == "monthly") & ~F.col("dimension_value").isin(excl),
                                                             F.col("cancel_rate_pct"))),
                worst_state_cancel_rate_pct=F.max(F.when(dim == "state", F.col("cancel_rate_pct")))),
        stacked(lagged,
                seller_rate_late=avg_round(F.when(late, F.col("seller_hist_late_rate")), 2, 2),
                seller_rate_ontime=avg_round(F.when(ontime, F.col("seller_hist_late_rate")), 2, 2),
                approval_lag_late=avg_round(F.when(late, F.col("approval_lag_hours")), 2, 2),
                approval_lag_ontime=avg_round(F.when(ontime, F.col("approval_lag_hours")), 2, 2),
                feature_rows=F.count(F.lit(1)),
                feature_nulls=sum(F.count(F.when(F.col(c).isNull(), 1)) for c in CORR_FEATURES)),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    literals = [x for m, e, t in p.expected_figures
                for x in (F.lit(m), F.struct(F.lit(float(e)).alias("e"), F.lit(float(t)).alias("t")))]
    known = F.try_element_at(F.create_map(*literals), F.col("metric"))
    out = out.withColumn("_k", known)
    result = (F.when(F.col("_k").isNull(), "NOT SET")
              .when(F.abs(F.col("value") - F.col("_k.e")) <= F.col("_k.t"), "OK").otherwise("DIFFERS"))
    return out.select("metric", "value", F.col("_k.e").alias("expected"), result.alias("result"))
