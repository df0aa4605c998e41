"""Registered analytical jobs.

Every builder takes the lazily built star and the parameters and returns a
DataFrame.  Order is only imposed where a LIMIT is the feature (top-k).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.params import Params
from mercato.plans import quality as Q
from mercato.plans import reports as R
from mercato.plans import shared as W
from mercato.plans import views as V
from mercato.plans.registry import register
from mercato.sources.load import loaded_once
from mercato.sources.star import MONTH, Star


# ------------------------------------------------------------ star tables
@register("clean_geolocation")
def q_clean_geolocation(s: Star, p: Params):
    return s.dim_geolocation


@register("clean_reviews")
def q_clean_reviews(s: Star, p: Params):
    return s.bridge_reviews


@register("payments_by_order")
def q_payments_by_order(s: Star, p: Params):
    return s.bridge_payments


@register("clean_products")
def q_clean_products(s: Star, p: Params):
    return s.dim_products


@register("fact_orders")
def q_fact_orders(s: Star, p: Params):
    # day measures are NUMERIC(8,2) in the star contract: emitted as double
    return s.fact_orders.drop(MONTH).withColumns(
        {c: F.col(c).cast("double") for c in ("days_to_deliver", "days_vs_estimate")}
    )


@register("star_smoke")
def q_star_smoke(s: Star, p: Params):
    """Orders, people and revenue by status over the joined star."""
    j = s.fact_orders.join(s.dim_customers, "customer_id").join(s.bridge_payments, "order_id")
    g = j.groupBy("order_status").agg(
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        F.sum("payment_value").alias("rev"),
    )
    return g.select(
        "order_status",
        F.col("orders").cast("long").alias("orders"),
        F.col("unique_customers").cast("long").alias("unique_customers"),
        F.col("rev").cast("double").alias("total_revenue"),
    )


# ------------------------------------------------------------ views
@register("revenue_by_category")
def q_revenue(s, p):
    return V.revenue_by_category(s, p)


@register("category_sla")
def q_sla(s, p):
    return V.category_sla(s, p)


@register("seller_performance")
def q_seller(s, p):
    return V.seller_performance(s, p)


@register("cancellation_analysis")
def q_cancel(s, p):
    return V.cancellation_analysis(s, p)


@register("monthly_cancellations")
def q_monthly_cancel(s, p):
    return V.monthly_cancellations(s, p)


@register("cohort_retention")
def q_cohort(s, p):
    return V.cohort_retention(s, p)


@register("rfm_scores")
def q_rfm(s, p):
    return V.rfm_scores(s, p)


@register("rfm_segment_summary")
def q_rfm_summary(s, p):
    return V.rfm_segment_summary(W.rfm_scores(s, p))


@register("delivery_delay_drivers")
def q_delay(s, p):
    return V.delivery_delay_drivers(s, p)


@register("unified_orders")
def q_unified(s, p):
    return V.unified_orders(s, p, V.rfm_scores(s, p), V.category_sla(s, p))


# ------------------------------------------------------------ reports over the views
def _reg(key, fn):
    register(key)(fn)


_reg("rfm_validation", lambda s, p: R.rfm_validation(W.rfm_scores(s, p)))
_reg("cohort_matrix", lambda s, p: R.cohort_matrix(W.cohort_retention(s, p), p))
_reg("cohort_shape", lambda s, p: R.cohort_shape(W.cohort_retention(s, p)))
_reg("cohort_dropoff", lambda s, p: R.cohort_dropoff(W.cohort_retention(s, p)))
_reg("cohort_best_period1", lambda s, p: R.cohort_best_period1(W.cohort_retention(s, p)))
_reg("cohort_summary", lambda s, p: R.cohort_summary(W.cohort_retention(s, p), p))
_reg("category_sla_summary", lambda s, p: R.category_sla_summary(W.category_sla(s, p)))
_reg("category_sla_worst10", lambda s, p: R.category_sla_worst10(W.category_sla(s, p)))
_reg("category_sla_top15", lambda s, p: R.category_sla_top15(W.category_sla(s, p), p))
_reg("revenue_vs_late", lambda s, p: R.revenue_vs_late(W.category_sla(s, p), W.revenue_by_category(s, p), p))
_reg("seller_sanity", lambda s, p: R.seller_sanity(W.seller_performance(s, p)))
_reg("seller_top_revenue", lambda s, p: R.seller_top_revenue(W.seller_performance(s, p)))
_reg("seller_high_risk", lambda s, p: R.seller_high_risk(W.seller_performance(s, p)))
_reg("seller_risk_tiers", lambda s, p: R.seller_risk_tiers(W.seller_performance(s, p), p))
_reg("revenue_shape", lambda s, p: R.revenue_shape(W.revenue_by_category(s, p)))
_reg("revenue_top5", lambda s, p: R.revenue_top5(W.revenue_by_category(s, p)))
_reg("revenue_peak_months", lambda s, p: R.revenue_peak_months(W.revenue_by_category(s, p)))
_reg("revenue_trend", lambda s, p: R.revenue_trend(W.revenue_by_category(s, p)))
_reg("revenue_summary", lambda s, p: R.revenue_summary(W.revenue_by_category(s, p)))
_reg("cancellation_by_dimension", lambda s, p: R.cancellation_by_dimension(W.cancellation_analysis(s, p)))
_reg("cancellation_platform_rate", lambda s, p: R.cancellation_platform_rate(W.cancellation_analysis(s, p)))
_reg("cancellation_hotspots", lambda s, p: R.cancellation_hotspots(W.cancellation_analysis(s, p)))
_reg("cancellation_monthly", lambda s, p: R.cancellation_monthly(W.cancellation_analysis(s, p), p))
_reg("cancellation_top_states", lambda s, p: R.cancellation_top_states(W.cancellation_analysis(s, p), p))
_reg("delay_feature_balance", lambda s, p: R.delay_feature_balance(V.delivery_delay_drivers(s, p)))
_reg("delay_feature_sanity", lambda s, p: R.delay_feature_sanity(V.delivery_delay_drivers(s, p)))
_reg("class_split", lambda s, p: R.class_split(V.delivery_delay_drivers(s, p)))
_reg("delay_outcome_means", lambda s, p: R.delay_outcome_means(V.delivery_delay_drivers(s, p)))
_reg("delay_driver_sample", lambda s, p: R.delay_driver_sample(W.delivery_delay_drivers(s, p), p))
_reg("delay_by_outcome", lambda s, p: R.delay_by_outcome(R.delay_driver_rows(W.delivery_delay_drivers(s, p), p)))
_reg("feature_correlation", lambda s, p: R.feature_correlation(V.delivery_delay_drivers(s, p)))
_reg("high_correlation_pairs",
     lambda s, p: R.high_correlation_pairs(R.feature_correlation(V.delivery_delay_drivers(s, p)), p))


_reg("unified_checks", lambda s, p: R.unified_checks(W.unified_orders(s, p)))
_reg("dash_segments", lambda s, p: R.dash_segments(W.unified_orders(s, p)))
_reg("dash_revenue_top5", lambda s, p: R.dash_revenue_top5(W.unified_orders(s, p), p))
_reg("dash_sla_top20", lambda s, p: R.dash_sla_top20(W.unified_orders(s, p), p))
_reg("dash_retention", lambda s, p: R.dash_retention(W.cohort_retention(s, p), p))
_reg("geo_drill", lambda s, p: R.geo_drill(W.unified_orders(s, p)))
_reg("ops_seller_kpis", lambda s, p: R.ops_seller_kpis(W.seller_performance(s, p)))
_reg("ops_top20_sellers", lambda s, p: R.ops_top20_sellers(W.seller_performance(s, p)))
_reg("ops_volume_vs_late", lambda s, p: R.ops_volume_vs_late(W.seller_performance(s, p)))
_reg("ops_cancel_trend", lambda s, p: R.ops_cancel_trend(V.monthly_cancellations(s, p), p))
_reg("ops_top15_categories",
     lambda s, p: R.ops_top15_categories(W.cancellation_analysis(s, p), s.dim_products))
_reg("ops_state_table", lambda s, p: R.ops_state_table(W.cancellation_analysis(s, p)))


# ------------------------------------------------------------ data quality
_reg("profile_tables", lambda s, p: Q.profile_tables(s.raw))
_reg("key_integrity", lambda s, p: Q.key_integrity(s.raw))
_reg("ghost_orders", lambda s, p: Q.ghost_orders(s.raw))
_reg("unmapped_categories", lambda s, p: Q.unmapped_categories(s.raw))
_reg("constraint_violations", lambda s, p: Q.constraint_violations(s))
_reg("row_count_report", lambda s, p: Q.row_count_report(s, loaded_once(s)))
_reg("duplicate_review_ids", lambda s, p: Q.duplicate_review_ids(s.raw))
_reg("duplicate_review_rows", lambda s, p: Q.duplicate_review_rows(s.raw))
_reg("zip_prefix_stats", lambda s, p: Q.zip_prefix_stats(s.raw))
_reg("items_per_order", lambda s, p: Q.items_per_order(s.raw))
_reg("geo_outliers", lambda s, p: Q.geo_outliers(s.raw, p))
_reg("delivery_anomalies", lambda s, p: Q.delivery_anomalies(s.raw, s, p))
_reg("long_deliveries", lambda s, p: Q.long_deliveries(s, p))
_reg("placeholder_report", lambda s, p: Q.placeholder_report(s, p))
_reg("cleaning_steps", lambda s, p: Q.cleaning_steps(s.raw, s, p))
_reg("extract_reconciliation", lambda s, p: Q.extract_reconciliation(W.rfm_scores(s, p), W.unified_rows(s, p)))
_reg("extract_difference_sample", lambda s, p: Q.extract_difference_sample(W.rfm_scores(s, p), W.unified_rows(s, p)))
_reg("seller_history_asof", lambda s, p: V.seller_history_asof(s, p))


@register("eda_sanity")
def q_eda_sanity(s: Star, p: Params):
    made = W.orders_once(s, p)  # three of the views need the dates of the orders
    return R.eda_sanity(
        W.rfm_scores(s, p), W.cohort_retention(s, p), W.revenue_by_category(s, p), W.category_sla(made, p),
        W.seller_performance(made, p), W.cancellation_analysis(s, p), W.delivery_delay_drivers(made, p), p)


# ------------------------------------------------------------ ML
from mercato.ml import jobs as ML  # noqa: E402

_reg("ml_features", ML.features)
_reg("ml_features_asof", ML.features_asof)
_reg("ml_null_category_rate", ML.null_category_rate)
_reg("ml_split_summary", ML.split_summary)
_reg("ml_rate_report", ML.rate_report)
_reg("ml_rate_curve", ML.rate_curve)
_reg("ml_rate_best_threshold", ML.rate_best_threshold)
_reg("ml_rate_confusion", ML.rate_confusion)
_reg("ml_seller_rate_psi", ML.seller_rate_psi)
_reg("ml_forest_report", ML.forest_report)
_reg("ml_logistic_report", ML.logistic_report)
_reg("ml_temporal_report", ML.temporal_report)
_reg("ml_confusion_matrix", ML.confusion)
_reg("ml_pr_curve", ML.pr_curve)
_reg("ml_best_threshold", ML.best_threshold)
_reg("ml_validated_threshold", ML.validated_threshold)
_reg("ml_feature_importance", ML.importance)
_reg("ml_batch_scores", ML.batch_scores)
_reg("ml_daily_top_risk", ML.daily_top_risk)


# ------------------------------------------------------------ profiling statistics (A13, A14) and 2B
from mercato.operators.profile import describe, value_counts  # noqa: E402

_reg("delivery_describe", lambda s, p: describe(
    s.fact_orders, ["days_to_deliver", "days_vs_estimate", "approval_lag_hours"]))
_reg("money_describe", lambda s, p: describe(s.fact_order_items, ["price", "freight_value"]).unionByName(
    describe(s.raw.payments, ["payment_value"])))
_reg("order_status_counts", lambda s, p: value_counts(s.raw.orders, "order_status"))
_reg("payment_type_counts", lambda s, p: value_counts(s.raw.payments, "payment_type"))
_reg("installments_top10", lambda s, p: value_counts(s.raw.payments, "payment_installments", top=10))
_reg("review_score_counts", lambda s, p: value_counts(s.raw.reviews, "review_score"))
_reg("category_counts", lambda s, p: value_counts(s.raw.products, "product_category_name", dropna=False, top=5))
_reg("cohort_period0", lambda s, p: W.cohort_retention(s, p).filter(F.col("period_number") == 0).select(
    "cohort_month", "cohort_size", "retention_rate_pct"))
