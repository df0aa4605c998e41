"""Oracle SQL per registered key (DuckDB dialect, driver tables as views)."""

from __future__ import annotations

from oracle import quality as OQ
from oracle import reports as OR
from oracle import views as OV
from oracle.base import with_star

SQL: dict[str, str] = {}


def q(key: str, *ctes: str, select: str) -> None:
    SQL[key] = with_star(*ctes, select=select)


# ------------------------------------------------------------ star tables
q("clean_geolocation", select="select * from dim_geolocation")
q("clean_reviews", select="select * from bridge_reviews")
q("payments_by_order", select="select * from bridge_payments")
q("clean_products", select="select * from dim_products")
q("fact_orders", select="select * replace (cast(days_to_deliver as double) as days_to_deliver, cast(days_vs_estimate as double) as days_vs_estimate) from fact_orders")
q("star_smoke", select="""
select o.order_status, cast(count(distinct o.order_id) as bigint) as orders,
       cast(count(distinct c.customer_unique_id) as bigint) as unique_customers,
       cast(sum(p.payment_value) as double) as total_revenue
from fact_orders o join dim_customers c using (customer_id) join bridge_payments p using (order_id)
group by o.order_status""")

# ------------------------------------------------------------ views
q("revenue_by_category", OV.REVENUE, select="select * from v_revenue_by_category")
q("category_sla", OV.SLA, select="select * from v_category_sla")
q("seller_performance", OV.SELLER, select="select * from v_seller_performance")
q("cancellation_analysis", OV.CANCEL, select="select * from v_cancellation_analysis")
MONTHLY_CANCEL = OV.cancellation_ctes(("canceled",), "mc") + """,
monthly_cancel AS (
  select substr(dimension_value, 1, 7) as order_month, cancelled_orders, total_orders, cancel_rate_pct
  from mc_view where analysis_dimension = 'monthly')"""
q("monthly_cancellations", MONTHLY_CANCEL, select="select * from monthly_cancel")
q("cohort_retention", OV.COHORT, select="select * from v_cohort_retention")
q("rfm_scores", OV.RFM, select="select * from v_rfm_scores")
q("rfm_segment_summary", OV.RFM, select=f"""
select segment, cast(count(*) as bigint) as customer_count,
       {OV.rr(OV.cents('sum(cast(monetary as decimal(18,2)))'), '100', 0)} as total_revenue,
       {OV.rr('sum(recency_days)', 'count(*)', 0)} as avg_recency_days,
       {OV.rr('sum(frequency)', 'count(*)', 2)} as avg_frequency
from v_rfm_scores group by segment""")
q("delivery_delay_drivers", OV.DELAY, select="select * from v_delivery_delay_drivers")
q("unified_orders", OV.RFM, OV.SLA, OV.UNIFIED, select="select * from v_unified_orders")

# ------------------------------------------------------------ reports
_DEPS = {
    "RFM": OV.RFM, "COHORT": OV.COHORT, "SLA": OV.SLA, "REVENUE": OV.REVENUE, "SELLER": OV.SELLER,
    "CANCEL": OV.CANCEL, "DELAY": OV.DELAY, "UNIFIED": OV.UNIFIED, "MONTHLY_CANCEL": MONTHLY_CANCEL,
}
for _key, (_deps, _text) in {**OR.SQL, **OQ.SQL}.items():
    q(_key, *[_DEPS[d] for d in _deps.split()], select=_text)
