"""The analytical views over the star.

Shared plan shape: join the item-grain fact to its order attributes, then
aggregate first to (group, order) and only then to the group.  The first step
is what COUNT(DISTINCT order_id) needs anyway; doing it explicitly lets every
other measure (item-grain sums, weighted averages, weighted percentiles) ride
on the same two partial aggregations instead of an Expand per distinct.  The
(group, order) shuffle key spreads a hot category or seller over all tasks.

Item-grain semantics of the reference are kept (SURVEY T3-T5): corrected,
order-grain measures are added as extra, separately named columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.numeric import round_ratio, unscaled
from mercato.functions.timefx import month_start, months_between_starts, pg_dow
from mercato.operators.ranking import By, ntiles
from mercato.params import Params
from mercato.session import written
from mercato.sources.star import Star


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def avg_money(sum_col, n_col) -> Column:
    """ROUND(AVG(money), 2) from an exact decimal sum and a row count."""
    return round_ratio(unscaled(sum_col, 2), n_col, 0) / F.lit(100.0)


def _n(col: Column, weight: Column) -> Column:
    return F.when(col.isNotNull(), weight).otherwise(0)


def _delivered_trusted(s: Star, p: Params) -> DataFrame:
    fo = s.fact_orders
    return fo.filter((F.col("order_status") == p.delivered_status) & ~F.col("has_placeholder_delivery_date"))


# ---------------------------------------------------------------- revenue
def revenue_by_category(s: Star, p: Params) -> DataFrame:
    orders = s.fact_orders.filter(F.col("order_status") == p.delivered_status).select(
        "order_id", month_start("order_purchase_timestamp").alias("order_month")
    )
    items = s.fact_order_items.select("order_id", "product_id", "price", "freight_value")
    prods = s.dim_products.select("product_id", "product_category_name")
    # Left join: items of unknown products still count towards the platform total.  Products first: the rows of an order
    # then lie in one task, where they are grouped without being dealt again.
    rows = items.join(prods, "product_id", "left").join(orders, "order_id")
    per_order = rows.groupBy("order_month", "product_category_name", "order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("price").alias("pr"),
        F.sum("freight_value").alias("fr"),
    )
    per_cat = per_order.groupBy("order_month", "product_category_name").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("n").alias("total_items"),
        F.sum("pr").alias("pr"),
        F.sum("fr").alias("fr"),
    ).withColumn("tr", F.col("pr") + F.col("fr"))
    platform = F.sum("tr").over(Window.partitionBy("order_month"))
    out = per_cat.withColumn("platform", platform).filter(F.col("product_category_name").isNotNull())
    return out.select(
        "order_month",
        "product_category_name",
        F.col("total_orders").cast("long").alias("total_orders"),
        F.col("total_items").cast("long").alias("total_items"),
        _d("pr").alias("product_revenue"),
        _d("fr").alias("freight_revenue"),
        _d("tr").alias("total_revenue"),
        avg_money("pr", "total_items").alias("avg_item_price"),
        avg_money("tr", "total_items").alias("avg_order_value"),
        avg_money("tr", "total_orders").alias("revenue_per_order"),
        _d("platform").alias("platform_revenue"),
        round_ratio(unscaled("tr", 2) * 100, unscaled("platform", 2), 2).alias("revenue_share_pct"),
    )


# ---------------------------------------------------------------- category SLA
def sla_tier(rate: Column, p: Params) -> Column:
    return (
        F.when(rate >= p.sla_critical, "Critical")
        .when(rate >= p.sla_below_average, "Below Average")
        .when(rate >= p.sla_average, "Average")
        .otherwise("Good")
    )


def category_sla(s: Star, p: Params) -> DataFrame:
    base = _delivered_trusted(s, p).select("order_id", "days_to_deliver", "days_vs_estimate", "is_late")
    prods = s.dim_products.filter(F.col("product_category_name").isNotNull()).select(
        "product_id", "product_category_name"
    )
    # products first: the rows of an order then lie in one task, where they are grouped without being dealt again
    rows = s.fact_order_items.select("order_id", "product_id").join(prods, "product_id").join(base, "order_id")
    per_order = rows.groupBy(
        "product_category_name", "order_id", "days_to_deliver", "days_vs_estimate", "is_late"
    ).agg(F.count(F.lit(1)).alias("n"))
    n, dtd, dve, late = F.col("n"), F.col("days_to_deliver"), F.col("days_vs_estimate"), F.col("is_late")
    st = per_order.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.when(late, n).otherwise(0)).alias("late_orders"),
        F.sum(F.when(late, 1).otherwise(0)).alias("late_distinct"),
        F.sum(dtd * n).alias("s_dtd"),
        F.sum(_n(dtd, n)).alias("c_dtd"),
        F.sum(dve * n).alias("s_dve"),
        F.sum(_n(dve, n)).alias("c_dve"),
        F.percentile(dtd, 0.5, n).alias("med_dtd"),
        F.percentile(dtd, 0.9, n).alias("p90_dtd"),
        F.percentile(dve, 0.5, n).alias("med_dve"),
    ).filter(F.col("total_orders") >= p.sla_min_orders)
    rate = round_ratio(F.col("late_orders") * 100, "total_orders", 2)
    return st.select(
        "product_category_name",
        F.col("total_orders").cast("long").alias("total_orders"),
        F.col("late_orders").cast("long").alias("late_orders"),
        rate.alias("late_rate_pct"),
        round_ratio("s_dtd", "c_dtd", 1).alias("avg_days_to_deliver"),
        F.round("med_dtd", 1).alias("median_days_to_deliver"),
        F.round("p90_dtd", 1).alias("p90_days_to_deliver"),
        round_ratio("s_dve", "c_dve", 1).alias("avg_days_vs_estimate"),
        F.round("med_dve", 1).alias("median_days_vs_estimate"),
        sla_tier(rate, p).alias("sla_tier"),
        round_ratio(F.col("late_distinct") * 100, "total_orders", 2).alias("order_late_rate_pct"),
    )


# ---------------------------------------------------------------- sellers (C14)
def seller_tier(rate: Column, orders: Column, p: Params) -> Column:
    hr, er, sp = p.seller_high_risk, p.seller_elevated_risk, p.seller_strong
    return (
        F.when((rate >= hr[0]) & (orders >= hr[1]), "High Risk")
        .when((rate >= er[0]) & (orders >= er[1]), "Elevated Risk")
        .when((rate < sp[0]) & (orders >= sp[1]), "Strong Performer")
        .otherwise("Average")
    )


def seller_performance(s: Star, p: Params) -> DataFrame:
    """Seller KPIs with the reference's review fan-out (T4) computed without the
    fan-out join: reviews are first reduced to one row per order, and every item
    row is weighted by the number of review rows it would have been joined to."""
    base = _delivered_trusted(s, p).select("order_id", "is_late", "days_to_deliver", "days_vs_estimate")
    rev = s.bridge_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("nrev"), F.sum("review_score").alias("ssum"), F.count("review_score").alias("scnt")
    )
    items = s.fact_order_items.select("order_id", "seller_id", (F.col("price") + F.col("freight_value")).alias("v"))
    rows = items.join(base, "order_id").join(rev, "order_id", "left")
    per_order = rows.groupBy(
        "seller_id", "order_id", "is_late", "days_to_deliver", "days_vs_estimate", "nrev", "ssum", "scnt"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    m = F.coalesce(F.col("nrev"), F.lit(1))
    n = F.col("n")
    nm = n * m
    dtd, dve, late = F.col("days_to_deliver"), F.col("days_vs_estimate"), F.col("is_late")
    st = per_order.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(nm).alias("rows"),
        F.sum(F.col("v") * m).alias("rev"),
        F.sum("v").alias("rev_dedup"),
        F.sum(F.when(late, nm).otherwise(0)).alias("late_orders"),
        F.sum(F.when(late, 1).otherwise(0)).alias("late_distinct"),
        F.sum(dtd * nm).alias("s_dtd"),
        F.sum(_n(dtd, nm)).alias("c_dtd"),
        F.sum(dve * nm).alias("s_dve"),
        F.sum(_n(dve, nm)).alias("c_dve"),
        F.sum(F.coalesce(F.col("ssum"), F.lit(0)) * n).alias("s_score"),
        F.sum(F.coalesce(F.col("scnt"), F.lit(0)) * n).alias("c_score"),
    ).filter(F.col("total_orders") >= p.seller_min_orders)
    st = st.join(s.dim_sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
    rate = round_ratio(F.col("late_orders") * 100, "total_orders", 2)
    return st.select(
        "seller_id",
        "seller_city",
        "seller_state",
        F.col("total_orders").cast("long").alias("total_orders"),
        _d("rev").alias("total_revenue"),
        avg_money("rev", "rows").alias("avg_order_value"),
        F.col("late_orders").cast("long").alias("late_orders"),
        rate.alias("late_rate_pct"),
        round_ratio("s_dtd", "c_dtd", 1).alias("avg_days_to_deliver"),
        round_ratio("s_dve", "c_dve", 1).alias("avg_days_vs_estimate"),
        round_ratio("s_score", "c_score", 2).alias("avg_review_score"),
        F.col("c_score").cast("long").alias("reviews_received"),
        seller_tier(rate, F.col("total_orders"), p).alias("seller_risk_tier"),
        _d("rev_dedup").alias("total_revenue_dedup"),
        round_ratio(F.col("late_distinct") * 100, "total_orders", 2).alias("order_late_rate_pct"),
    )


# ---------------------------------------------------------------- cancellations
def _cancel_flag(statuses) -> Column:
    return F.col("order_status").isin(list(statuses)).cast("int")


def _cancel_orders(s: Star, statuses) -> DataFrame:
    cust = s.dim_customers.select("customer_id", "customer_state")
    return s.fact_orders.join(cust, "customer_id").select(
        "order_id",
        month_start("order_purchase_timestamp").alias("order_month"),
        "customer_state",
        _cancel_flag(statuses).alias("is_cancelled"),
    )


def cancellation_analysis(s: Star, p: Params, statuses=None) -> DataFrame:
    """C19.  The three breakdowns are grouping sets over one joined frame: a row
    per order and category of its items, of which `first` marks one per order.
    Months and states count the marked rows, categories count all of theirs,
    cancelled ones at the published item grain."""
    cats = (s.fact_order_items.select("order_id", "product_id")
            .join(s.dim_products.select("product_id", "product_category_name"), "product_id")
            .filter(F.col("product_category_name").isNotNull() & F.col("order_id").isNotNull())
            # both aggregates below are made where the rows of an order have met
            .repartition("order_id").groupBy("order_id", "product_category_name").agg(F.count(F.lit(1)).alias("n")))
    # an order has as many entries as there are categories at most
    per_order = cats.groupBy("order_id").agg(F.collect_list(F.struct("product_category_name", "n")).alias("cats"))
    rows = (_cancel_orders(s, statuses or p.cancel_statuses).join(per_order, "order_id", "left")
            .select("order_month", "customer_state", "is_cancelled", F.posexplode_outer("cats").alias("pos", "c"))
            .select(F.col("order_month").cast("string").alias("month"), F.col("customer_state").alias("state"), "is_cancelled",
                    F.col("c.product_category_name").alias("category"), F.col("c.n").alias("n"),
                    (F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("first")))
    flag = F.col("is_cancelled")
    g = rows.groupingSets([["month"], ["state"], ["category"]], "month", "state", "category").agg(
        F.grouping_id().alias("_set"),  # a bit for each column that is not grouped by
        F.sum("first").alias("orders"),
        F.sum(flag * F.col("first")).alias("cancelled"),
        F.count("n").alias("in_category"),
        F.sum(flag * F.col("n")).alias("items_cancelled"),
        F.sum(F.when(F.col("n").isNotNull(), flag)).alias("in_category_cancelled"),
    )
    of = {3: ("monthly", "month", p.cancel_min_orders_month), 5: ("state", "state", p.cancel_min_orders_state),
          6: ("category", "category", p.cancel_min_orders_category)}

    def pick(values) -> Column:
        return F.coalesce(*[F.when(F.col("_set") == k, v) for k, v in values.items()])

    is_cat = F.col("_set") == 6
    x = g.filter(~is_cat | F.col("category").isNotNull()).select(
        pick({k: F.lit(v[0]) for k, v in of.items()}).alias("analysis_dimension"),
        pick({k: F.col(v[1]) for k, v in of.items()}).alias("dimension_value"),
        F.when(is_cat, F.col("in_category")).otherwise(F.col("orders")).cast("long").alias("total_orders"),
        F.when(is_cat, F.col("items_cancelled")).otherwise(F.col("cancelled")).cast("long").alias("cancelled_orders"),
        F.when(is_cat, F.col("in_category_cancelled")).otherwise(F.col("cancelled")).alias("_distinct"),
        pick({k: F.lit(v[2]) for k, v in of.items()}).alias("_least"),
    ).filter(F.col("total_orders") >= F.col("_least"))
    return x.select(
        "analysis_dimension", "dimension_value", "total_orders", "cancelled_orders",
        round_ratio(F.col("cancelled_orders") * 100, "total_orders", 2).alias("cancel_rate_pct"),
        F.lit(None).cast("string").alias("secondary_dimension"),
        round_ratio(F.col("_distinct") * 100, "total_orders", 2).alias("order_cancel_rate_pct"),
    )


def monthly_cancellations(s: Star, p: Params) -> DataFrame:
    """Canceled-only monthly rates, month as yyyy-MM (the shipped monthly file)."""
    g = _cancel_orders(s, p.cancel_statuses_narrow).groupBy("order_month").agg(
        F.count(F.lit(1)).cast("long").alias("total_orders"), F.sum("is_cancelled").cast("long").alias("cancelled_orders"))
    return g.filter(F.col("total_orders") >= p.cancel_min_orders_month).select(
        F.substring(F.col("order_month").cast("string"), 1, 7).alias("order_month"),
        "cancelled_orders",
        "total_orders",
        round_ratio(F.col("cancelled_orders") * 100, "total_orders", 2).alias("cancel_rate_pct"),
    )


# ---------------------------------------------------------------- cohorts
def cohort_retention(s: Star, p: Params) -> DataFrame:
    """Cohort x period retention.  (person, month) pairs are made distinct first
    (map-side), so the per-person window sees at most one row per month: a hot
    person cannot overload a task, and COUNT(DISTINCT person) becomes COUNT(*)."""
    kept = s.fact_orders.filter(~F.col("order_status").isin(list(p.cancel_statuses)))
    pm = (
        kept.join(s.dim_customers.select("customer_id", "customer_unique_id"), "customer_id")
        .select("customer_unique_id", month_start("order_purchase_timestamp").alias("order_month"))
        .distinct()
    )
    first = F.min("order_month").over(Window.partitionBy("customer_unique_id"))
    act = pm.withColumn("cohort_month", first).withColumn(
        "period_number", months_between_starts("order_month", "cohort_month").cast("int")
    )
    active = act.groupBy("cohort_month", "period_number").agg(F.count(F.lit(1)).alias("active_customers"))
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    out = active.withColumn("cohort_size", size).filter(
        F.col("cohort_month").between(F.lit(p.cohort_start), F.lit(p.cohort_end)) & F.col("cohort_size").isNotNull()
    )
    return out.select(
        "cohort_month",
        F.col("cohort_size").cast("long").alias("cohort_size"),
        "period_number",
        F.col("active_customers").cast("long").alias("active_customers"),
        round_ratio(F.col("active_customers") * 100, "cohort_size", 2).alias("retention_rate_pct"),
        round_ratio("active_customers", "cohort_size", 4).alias("retention_rate"),
    )


# ---------------------------------------------------------------- RFM
# fixed values: the segment ladder, first match wins
def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 3) & (f >= 3) & (m >= 3), "Champions")
        .when((r >= 3) & (f >= 2), "Loyal Customers")
        .when((r >= 3) & (f == 1), "Potential Loyalists")
        .when((r == 2) & (f >= 3), "At Risk")
        .when((r == 1) & (f >= 3), "Cannot Lose Them")
        .when((r == 2) & (f == 2), "Needs Attention")
        .when((r == 1) & (f == 2), "Hibernating")
        .otherwise("Lost")
    )


def rfm_raw(s: Star, p: Params) -> DataFrame:
    """Per (person, city, state): frequency, monetary, last order date, recency.

    fact_orders x bridge_payments is 1:1 on the order key (both are keyed by
    order_id; `constraint_violations` checks it), so COUNT(DISTINCT order_id)
    equals COUNT(*) here and needs no extra distinct aggregation."""
    orders = s.fact_orders.filter(F.col("order_status") == p.delivered_status).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )
    # payments first: the customer's columns are not dealt by order
    rows = orders.join(s.bridge_payments.select("order_id", "payment_value"), "order_id").join(
        s.dim_customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state"), "customer_id")
    g = rows.groupBy("customer_unique_id", "customer_city", "customer_state").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("payment_value").alias("monetary"),
        F.max(F.to_date("order_purchase_timestamp")).alias("last_order_date"),
    )
    return g.withColumn("recency_days", F.datediff(F.lit(p.rfm_reference_date), F.col("last_order_date")))


def rfm_scores(s: Star, p: Params) -> DataFrame:
    """C7.  The person rows are stored once; the three NTILEs compare them with
    their cut rows (see mercato.operators.ranking)."""
    tie = [By("customer_unique_id"), By("customer_city"), By("customer_state")]
    x = ntiles(written(rfm_raw(s, p), "rfm"), 4, {
        "r_score": [By("recency_days", descending=True, nulls_last=True), *tie],
        "f_score": [By("frequency"), *tie],
        "m_score": [By("monetary"), *tie],
    })
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return x.select(
        "customer_unique_id",
        "customer_city",
        "customer_state",
        F.col("recency_days").cast("int").alias("recency_days"),
        F.col("frequency").cast("long").alias("frequency"),
        _d("monetary").alias("monetary"),
        "last_order_date",
        r.cast("int").alias("r_score"),
        f.cast("int").alias("f_score"),
        m.cast("int").alias("m_score"),
        (r + f + m).cast("int").alias("rfm_total"),
        rfm_segment(r, f, m).alias("segment"),
    )


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    g = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(F.col("monetary").cast("decimal(18,2)")).alias("rev"),
        F.sum("recency_days").alias("s_rec"),
        F.sum("frequency").alias("s_freq"),
    )
    return g.select(
        "segment",
        F.col("customer_count").cast("long").alias("customer_count"),
        round_ratio(unscaled("rev", 2), F.lit(100), 0).alias("total_revenue"),
        round_ratio("s_rec", "customer_count", 0).alias("avg_recency_days"),
        round_ratio("s_freq", "customer_count", 2).alias("avg_frequency"),
    )


# ---------------------------------------------------------------- delay drivers
def seller_history(s: Star, p: Params) -> DataFrame:
    """Seller features over all delivered, trusted orders (as the reference: includes
    the future and the order itself; see seller_history_asof for the fix)."""
    base = _delivered_trusted(s, p).select("order_id", "is_late", "days_to_deliver")
    rows = s.fact_order_items.select("order_id", "seller_id").join(base, "order_id")
    per_order = rows.groupBy("seller_id", "order_id", "is_late", "days_to_deliver").agg(F.count(F.lit(1)).alias("n"))
    n, dtd = F.col("n"), F.col("days_to_deliver")
    g = per_order.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("seller_total_orders"),
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("is_late"), n).otherwise(0)).alias("late"),
        F.sum(dtd * n).alias("s_dtd"),
        F.sum(_n(dtd, n)).alias("c_dtd"),
    )
    return g.select(
        "seller_id",
        F.col("seller_total_orders").cast("long").alias("seller_total_orders"),
        round_ratio(F.col("late") * 100, "rows", 2).alias("seller_hist_late_rate"),
        round_ratio("s_dtd", "c_dtd", 1).alias("seller_avg_days_to_deliver"),
    )


def delivery_delay_drivers(s: Star, p: Params, sellers: DataFrame | None = None) -> DataFrame:
    """One row per delivered, trusted order with items and payment.

    The reference builds three per-order item aggregates (value features,
    product features, primary seller) and joins them; here they are one
    aggregate over items left-joined to products, so the item rows are
    shuffled once.  The inner-join semantics are kept as filters: an order
    needs at least one item with a known product and an item number 1."""
    ob = _delivered_trusted(s, p).filter(F.col("has_items") & F.col("has_payment")).select(
        "order_id", "customer_id", "is_late", "approval_lag_hours",
        pg_dow("order_purchase_timestamp").cast("int").alias("order_day_of_week"),
        F.hour("order_purchase_timestamp").cast("int").alias("order_hour"),
        F.month("order_purchase_timestamp").cast("int").alias("order_month_num"),
    )
    pr = s.dim_products
    vol = (F.coalesce(pr.product_length_cm, F.lit(0)) * F.coalesce(pr.product_height_cm, F.lit(0))
           * F.coalesce(pr.product_width_cm, F.lit(0)))
    prods = pr.select("product_id", "product_weight_g", "product_category_name", vol.alias("vol"),
                      F.lit(True).alias("_known"))
    # items of other orders stay out before they are dealt by product and back; the columns are those of
    # `seller_history`, whose exchanges are used again
    kept = _delivered_trusted(s, p).select("order_id", "is_late", "days_to_deliver")
    items = s.fact_order_items.select("order_id", "order_item_id", "seller_id", "price", "freight_value", "product_id")
    rows = items.join(kept, "order_id", "left_semi").join(prods, "product_id", "left")
    known = F.col("_known")
    first_item = F.col("order_item_id") == 1
    # rows of an order come from as many tasks as it has products: dealt by order before the aggregate they are
    # smaller than its partial sets and modes
    per_order = rows.filter(F.col("order_id").isNotNull()).repartition("order_id").groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"),
        F.size(F.collect_set("seller_id")).alias("seller_count"),  # distinct sellers of one order: small
        F.sum("price").alias("sp"),
        F.sum("freight_value").alias("sf"),
        F.count("price").alias("cp"),
        F.sum(F.when(known, unscaled("product_weight_g", 2))).alias("sw"),
        F.count(F.when(known, F.col("product_weight_g"))).alias("cw"),
        F.sum(F.when(known, unscaled("vol", 6))).alias("sv"),
        F.count(F.when(known, 1)).alias("known_items"),
        F.mode(F.when(known, F.col("product_category_name")), True).alias("primary_category"),
        F.max(F.when(first_item, F.col("seller_id"))).alias("primary_seller"),
        F.count(F.when(first_item, 1)).alias("first_items"),
    ).filter((F.col("known_items") > 0) & (F.col("first_items") > 0))
    feats = per_order.select(
        "order_id", "primary_seller", "primary_category",
        F.col("item_count").cast("long").alias("item_count"),
        F.col("seller_count").cast("long").alias("seller_count"),
        _d("sp").alias("order_value"),
        _d("sf").alias("freight_value"),
        avg_money("sp", "cp").alias("avg_item_price"),
        round_ratio(unscaled("sf", 2) * 100, unscaled("sp", 2), 2).alias("freight_ratio_pct"),
        round_ratio("sw", F.col("cw") * 100, 1).alias("avg_product_weight_g"),
        round_ratio("sv", F.col("known_items") * 1_000_000, 1).alias("avg_product_volume_cm3"),
    )
    sf = (sellers if sellers is not None else seller_history(s, p)).withColumnRenamed("seller_id", "primary_seller")
    cust = s.dim_customers.select("customer_id", "customer_state")
    # the state joins the few columns of the order, not the features
    j = ob.join(cust, "customer_id").join(feats, "order_id").join(sf, "primary_seller")
    return j.select(
        "order_id", "is_late", "order_day_of_week", "order_hour", "order_month_num",
        "item_count", "seller_count", "order_value", "freight_value", "avg_item_price", "freight_ratio_pct",
        "avg_product_weight_g", "avg_product_volume_cm3", "primary_category",
        "seller_hist_late_rate", "seller_avg_days_to_deliver", "seller_total_orders",
        "customer_state", _d("approval_lag_hours").alias("approval_lag_hours"),
    )


# ---------------------------------------------------------------- unified table
def rfm_per_person(rfm: DataFrame) -> DataFrame:
    """One RFM row per person (T1): latest last order, then highest monetary,
    then city, state.  Min over a struct: an aggregate, skew-safe."""
    key = F.struct(
        (-F.datediff("last_order_date", F.lit("1970-01-01"))).alias("k1"),
        (-F.col("monetary")).alias("k2"),
        F.col("customer_city").alias("k3"),
        F.col("customer_state").alias("k4"),
        *[F.col(c) for c in ("segment", "r_score", "f_score", "m_score", "rfm_total",
                             "recency_days", "frequency", "monetary")],
    )
    g = rfm.groupBy("customer_unique_id").agg(F.min(key).alias("x"))
    return g.select("customer_unique_id", *[F.col(f"x.{c}").alias(c) for c in (
        "segment", "r_score", "f_score", "m_score", "rfm_total", "recency_days", "frequency", "monetary")])


def unified_orders(s: Star, p: Params, rfm: DataFrame, sla: DataFrame) -> DataFrame:
    """Delivered items with customer, RFM, product and category-SLA columns.

    Joined in grain order: order-level attributes (customer, one RFM row per
    person) are attached to the orders first, product attributes to the items,
    and the two meet once on order_id -- the wide item rows are never shuffled
    on the person key, nor on the category."""
    o = s.fact_orders.filter(F.col("order_status") == p.delivered_status).select(
        "order_id", "customer_id", "order_purchase_timestamp", "order_status", "is_late", "days_to_deliver",
        "days_vs_estimate")
    c = s.dim_customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    orders = o.join(c, "customer_id").join(rfm_per_person(rfm), "customer_unique_id", "left")
    it = s.fact_order_items.select("order_id", "order_item_id", "product_id", "price", "freight_value")
    pr = s.dim_products.select("product_id", "product_category_name", "product_category_name_english")
    sl = sla.select(
        "product_category_name",
        F.col("late_rate_pct").alias("category_late_rate_pct"),
        F.col("avg_days_to_deliver").alias("category_avg_days_to_deliver"),
        F.col("p90_days_to_deliver").alias("category_p90_days_to_deliver"),
        F.col("sla_tier").alias("category_sla_tier"),
        F.col("avg_days_vs_estimate").alias("category_avg_days_vs_estimate"),
    )
    # a row per category: sent to every task, after the rows have met, so that no row moves for it
    j = it.join(pr, "product_id").join(orders, "order_id").join(F.broadcast(sl), "product_category_name", "left")
    ts = F.col("order_purchase_timestamp")
    return j.select(
        "customer_unique_id", "customer_city", "customer_state", "segment", "r_score", "f_score", "m_score",
        "rfm_total", "recency_days", "frequency", "monetary",
        "order_id",
        month_start(ts).alias("order_month"),
        F.year(ts).cast("int").alias("order_year"),
        F.month(ts).cast("int").alias("order_month_num"),
        "order_status", "is_late", _d("days_to_deliver").alias("days_to_deliver"),
        _d("days_vs_estimate").alias("days_vs_estimate"),
        "order_item_id", _d("price").alias("price"), _d("freight_value").alias("freight_value"),
        "product_category_name", "product_category_name_english",
        "category_late_rate_pct", "category_avg_days_to_deliver", "category_p90_days_to_deliver",
        "category_sla_tier", "category_avg_days_vs_estimate",
    )


# ---------------------------------------------------------------- as-of seller history
def seller_history_asof(s: Star, p: Params) -> DataFrame:
    """Seller features over strictly earlier orders (the point-in-time version of
    seller_history that the model card asks for).

    Grain: one row per (seller, delivered trusted order).  The rows are dealt by
    ranges of (seller, timestamp) and stored once; a range starts with what its
    seller has in earlier ranges, and sums go on inside it.  A seller with many
    orders lies in many ranges, so no task holds more than its range, and every
    row is shuffled twice after the join.
    """
    base = _delivered_trusted(s, p).select("order_id", "order_purchase_timestamp", "is_late", "days_to_deliver")
    rows = s.fact_order_items.select("order_id", "seller_id").filter(F.col("seller_id").isNotNull()).join(base, "order_id")
    per_order = rows.groupBy("seller_id", "order_id", "order_purchase_timestamp", "is_late", "days_to_deliver").agg(
        F.count(F.lit(1)).alias("n"))
    n, dtd = F.col("n"), F.col("days_to_deliver")
    meas = {"o": F.lit(1), "r": n, "l": F.when(F.col("is_late"), n).otherwise(0),
            "sd": F.coalesce(dtd * n, F.lit(0)), "cd": _n(dtd, n)}
    keys = ["seller_id", "order_purchase_timestamp"]
    parts = int(s.fact_orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = per_order.select(*keys, "order_id", *[v.alias(m) for m, v in meas.items()]).repartitionByRange(parts, *keys)
    # the bounds come from a sample, so the ranges must not be made twice
    x = written(placed.withColumn("_part", F.spark_partition_id()), "seller_orders")
    totals = x.groupBy("seller_id", "_part").agg(*[F.sum(m).alias(f"t_{m}") for m in meas])
    earlier = Window.partitionBy("seller_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("seller_id", "_part", *[F.coalesce(F.sum(f"t_{m}").over(earlier), F.lit(0)).alias(f"b_{m}") for m in meas])
    # equal timestamps lie in one range: they count for none of each other
    w = Window.partitionBy("seller_id", "_part").orderBy("order_purchase_timestamp")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = w.rangeBetween(Window.currentRow, Window.currentRow)
    local = x.select(*keys, "order_id", "_part", *[(F.sum(m).over(upto) - F.sum(m).over(equal)).alias(f"l_{m}") for m in meas])
    j = local.filter(F.col("order_purchase_timestamp").isNotNull()).join(starts, ["seller_id", "_part"])
    tot = {m: F.col(f"b_{m}") + F.col(f"l_{m}") for m in meas}
    return j.select(
        "seller_id", "order_id", "order_purchase_timestamp",
        tot["o"].cast("long").alias("seller_prior_orders"),
        round_ratio(tot["l"] * 100, tot["r"], 2).alias("seller_prior_late_rate"),
        round_ratio(tot["sd"], tot["cd"], 1).alias("seller_prior_avg_days_to_deliver"),
    )


# ---------------------------------------------------------------- named SQL views
VIEW_NAMES = {
    "v_rfm_scores": lambda s, p: rfm_scores(s, p),
    "v_cohort_retention": lambda s, p: cohort_retention(s, p),
    "v_category_sla": lambda s, p: category_sla(s, p),
    "v_seller_performance": lambda s, p: seller_performance(s, p),
    "v_revenue_by_category": lambda s, p: revenue_by_category(s, p),
    "v_cancellation_analysis": lambda s, p: cancellation_analysis(s, p),
    "v_delivery_delay_drivers": lambda s, p: delivery_delay_drivers(s, p),
}


def register_views(s: Star, p: Params, prefix: str = "") -> list[str]:
    """Temp views over the star tables and the analytical views, so reports can
    be written as `spark.sql(...)` against the same names the SQL layer uses.
    RFM's person rows are stored once and reused by the unified view."""
    s.register(prefix)
    names = []
    rfm = None
    for name, fn in VIEW_NAMES.items():
        df = fn(s, p)
        if name == "v_rfm_scores":
            rfm = df
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    unified_orders(s, p, rfm, category_sla(s, p)).createOrReplaceTempView(prefix + "v_unified_orders")
    return names + [prefix + "v_unified_orders"]
