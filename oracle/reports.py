"""Oracle SQL for the report keys (validations, chart data, dashboards, ops)."""

from __future__ import annotations

from mercato.params import FIXTURE_PARAMS as P
from oracle.base import cents, dlist, id_bits, rr

CORR_FEATURES = [
    "is_late", "item_count", "seller_count", "order_value", "freight_value", "avg_item_price",
    "freight_ratio_pct", "avg_product_weight_g", "avg_product_volume_cm3", "seller_hist_late_rate",
    "seller_avg_days_to_deliver", "seller_total_orders", "approval_lag_hours", "order_hour", "order_month_num",
]
UNIFIED_COLS = [
    "customer_unique_id", "customer_city", "customer_state", "segment", "r_score", "f_score", "m_score",
    "rfm_total", "recency_days", "frequency", "monetary", "order_id", "order_month", "order_year",
    "order_month_num", "order_status", "is_late", "days_to_deliver", "days_vs_estimate", "order_item_id",
    "price", "freight_value", "product_category_name", "product_category_name_english",
    "category_late_rate_pct", "category_avg_days_to_deliver", "category_p90_days_to_deliver",
    "category_sla_tier", "category_avg_days_vs_estimate",
]


def avg_round(x: str, scale: int, digits: int) -> str:
    return rr(f"sum({cents(x, scale)})", f"count({x}) * {10**scale}", digits)


def sum_round(x: str, scale: int, digits: int) -> str:
    return rr(f"sum({cents(x, scale)})", str(10**scale), digits)


def title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower(replace({x}, '_', ' ')), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def _cnt(cond: str) -> str:
    return f"cast(count(case when {cond} then 1 end) as bigint)"


COHORT_KEPT = f"cohort_month not in ({dlist(P.cohort_exclude)})"

SQL = {
    "rfm_validation": ("RFM", f"""
select cast(count(*) as bigint) as total_customers, {_cnt('segment is null')} as null_segments,
       {_cnt('monetary <= 0')} as zero_monetary, min(recency_days) as min_recency, max(recency_days) as max_recency
from v_rfm_scores"""),
    "cohort_matrix": ("COHORT", f"""
select cohort_month, strftime(cohort_month, '%b %Y') as cohort_label,
       {", ".join(f'max(retention_rate_pct) filter (where period_number = {k}) as "{k}"' for k in range(P.cohort_periods()))}
from v_cohort_retention where {COHORT_KEPT} group by cohort_month"""),
    "cohort_shape": ("COHORT", """
select cast(count(*) as bigint) as total_rows, cast(count(distinct cohort_month) as bigint) as cohort_count,
       max(period_number) as max_period, min(retention_rate_pct) as min_retention,
       max(retention_rate_pct) as max_retention
from v_cohort_retention"""),
    "cohort_dropoff": ("COHORT", f"""
select period_number, {avg_round('retention_rate_pct', 2, 2)} as avg_retention_pct,
       max(retention_rate_pct) as max_retention_pct
from v_cohort_retention where period_number <= 6 group by period_number"""),
    "cohort_best_period1": ("COHORT", """
select cohort_month, cohort_size, active_customers, retention_rate_pct from v_cohort_retention
where period_number = 1 and cohort_size > 10
order by retention_rate_pct desc, cohort_month asc limit 10"""),
    "cohort_summary": ("COHORT", f"""
select cast(count(distinct cohort_month) as bigint) as cohorts, max(retention_rate_pct) as max_retention
from v_cohort_retention where {COHORT_KEPT} and period_number > 0"""),
    "category_sla_summary": ("SLA", f"""
select cast(count(*) as bigint) as total_categories, cast(sum(total_orders) as bigint) as total_orders_covered,
       {avg_round('late_rate_pct', 2, 2)} as avg_late_rate, max(late_rate_pct) as worst_category_rate,
       min(late_rate_pct) as best_category_rate, {_cnt("sla_tier = 'Critical'")} as critical_count,
       {_cnt("sla_tier = 'Below Average'")} as below_avg_count
from v_category_sla"""),
    "category_sla_worst10": ("SLA", """
select product_category_name, total_orders, late_rate_pct, avg_days_to_deliver, p90_days_to_deliver, sla_tier
from v_category_sla order by late_rate_pct desc, product_category_name asc limit 10"""),
    "category_sla_top15": ("SLA", f"""
select product_category_name, total_orders, late_rate_pct, avg_days_to_deliver, p90_days_to_deliver, sla_tier,
       {title('product_category_name')} as category_display
from v_category_sla where total_orders >= {P.sla_min_orders}
order by late_rate_pct desc, product_category_name asc limit 15"""),
    "revenue_vs_late": ("SLA REVENUE", f"""
, rvl_cats AS (select product_category_name, total_orders, late_rate_pct, avg_days_to_deliver, sla_tier
               from v_category_sla where total_orders >= {P.revenue_vs_late_min_orders}),
rvl_rev AS (select product_category_name, sum({cents('total_revenue')}) as rev_c from v_revenue_by_category
            group by product_category_name),
rvl AS (select c.*, r.rev_c / 100.0 as total_revenue from rvl_cats c left join rvl_rev r
        on c.product_category_name = r.product_category_name)
select product_category_name, total_orders, late_rate_pct, avg_days_to_deliver, sla_tier, total_revenue,
       round(total_orders / (select max(total_orders) from rvl) * 1200 + 40, 4) as bubble_size,
       late_rate_pct >= (select quantile_cont(late_rate_pct, 0.5) from rvl) as above_median_late,
       total_revenue >= (select quantile_cont(total_revenue, 0.5) from rvl) as above_median_revenue,
       row_number() over (order by total_revenue desc nulls last, product_category_name) <= 8 as is_top8_revenue
from rvl"""),
    "seller_sanity": ("SELLER", f"""
select cast(count(*) as bigint) as total_sellers, {sum_round('total_revenue', 2, 0)} as platform_revenue,
       {avg_round('late_rate_pct', 2, 2)} as avg_seller_late_rate,
       {_cnt("seller_risk_tier = 'High Risk'")} as high_risk_sellers,
       {_cnt("seller_risk_tier = 'Strong Performer'")} as strong_sellers,
       min(avg_review_score) as min_review_score, max(avg_review_score) as max_review_score
from v_seller_performance"""),
    "seller_top_revenue": ("SELLER", """
select seller_id, seller_state, total_orders, total_revenue, late_rate_pct, avg_review_score, seller_risk_tier
from v_seller_performance order by total_revenue desc, seller_id asc limit 10"""),
    "seller_high_risk": ("SELLER", """
select seller_id, seller_state, total_orders, late_rate_pct, avg_days_to_deliver, avg_review_score, seller_risk_tier
from v_seller_performance where seller_risk_tier = 'High Risk'
order by late_rate_pct desc, seller_id asc limit 10"""),
    "seller_risk_tiers": ("SELLER", f"""
, srt AS (
  select seller_risk_tier, cast(count(*) as bigint) as seller_count,
         {sum_round('total_revenue', 2, 0)} as total_revenue, {avg_round('late_rate_pct', 2, 2)} as avg_late_rate,
         {avg_round('avg_review_score', 2, 3)} as avg_review_score
  from v_seller_performance where total_orders >= {P.seller_min_orders} group by seller_risk_tier)
select t.seller_risk_tier, t.tier_order, cast(s.seller_count as double) as seller_count, s.total_revenue, s.avg_late_rate, s.avg_review_score
from (values ('High Risk', 1), ('Elevated Risk', 2), ('Average', 3), ('Strong Performer', 4))
     t(seller_risk_tier, tier_order)
left join srt s on t.seller_risk_tier = s.seller_risk_tier"""),
    "revenue_shape": ("REVENUE", f"""
select cast(count(*) as bigint) as total_rows, cast(count(distinct order_month) as bigint) as months_covered,
       cast(count(distinct product_category_name) as bigint) as categories_covered,
       {sum_round('total_revenue', 2, 0)} as sum_of_category_revenue
from v_revenue_by_category"""),
    "revenue_top5": ("REVENUE", f"""
select product_category_name, cast(sum(total_orders) as bigint) as total_orders,
       {sum_round('total_revenue', 2, 0)} as total_revenue,
       {avg_round('revenue_share_pct', 2, 2)} as avg_monthly_share_pct
from v_revenue_by_category group by product_category_name
order by total_revenue desc, product_category_name asc limit 5"""),
    "revenue_peak_months": ("REVENUE", f"""
select order_month, {sum_round('total_revenue', 2, 0)} as monthly_revenue,
       cast(sum(total_orders) as bigint) as monthly_orders
from v_revenue_by_category group by order_month order by monthly_revenue desc, order_month asc limit 5"""),
    "revenue_trend": ("REVENUE", f"""
select order_month, sum({cents('total_revenue')}) / 100.0 as total_revenue,
       cast(sum(total_orders) as bigint) as total_orders
from v_revenue_by_category group by order_month"""),
    "revenue_summary": ("REVENUE", f"""
, rm AS (select order_month, sum({cents('total_revenue')}) as rev_c from v_revenue_by_category group by order_month)
select cast(count(*) as bigint) as months,
       (select order_month from rm order by rev_c desc, order_month limit 1) as peak_month,
       max(rev_c) / 100.0 as peak_revenue, sum(rev_c) / 100.0 as total_revenue
from rm"""),
    "cancellation_by_dimension": ("CANCEL", f"""
select analysis_dimension, cast(count(*) as bigint) as dimension_rows,
       {avg_round('cancel_rate_pct', 2, 2)} as avg_cancel_rate,
       min(cancel_rate_pct) as min_cancel_rate, max(cancel_rate_pct) as max_cancel_rate
from v_cancellation_analysis group by analysis_dimension"""),
    "cancellation_platform_rate": ("CANCEL", f"""
select cast(sum(cancelled_orders) as bigint) as total_cancelled, cast(sum(total_orders) as bigint) as total_orders,
       {rr('sum(cancelled_orders) * 100', 'sum(total_orders)', 2)} as platform_cancel_rate
from v_cancellation_analysis where analysis_dimension = 'monthly'"""),
    "cancellation_hotspots": ("CANCEL", """
select analysis_dimension, dimension_value, total_orders, cancel_rate_pct
from v_cancellation_analysis
where analysis_dimension in ('state', 'category') and cancel_rate_pct > 5
order by analysis_dimension asc, cancel_rate_pct desc, dimension_value asc limit 20"""),
    "cancellation_monthly": ("CANCEL", f"""
select cast(dimension_value as date) as order_month, total_orders, cancelled_orders, cancel_rate_pct
from v_cancellation_analysis
where analysis_dimension = 'monthly'
  and dimension_value not in ({", ".join(f"'{d.isoformat()}'" for d in P.cancel_exclude_months)})"""),
    "cancellation_top_states": ("CANCEL", f"""
select dimension_value as state, total_orders, cancelled_orders, cancel_rate_pct
from v_cancellation_analysis where analysis_dimension = 'state' and total_orders >= {P.cancel_min_orders_state}
order by cancel_rate_pct desc, state asc limit 15"""),
    "delay_feature_balance": ("DELAY", f"""
select cast(count(*) as bigint) as total_orders, cast(sum(case when is_late then 1 else 0 end) as bigint) as late_orders,
       {rr('sum(case when is_late then 1 else 0 end) * 100', 'count(*)', 2)} as late_rate_pct,
       {_cnt('avg_product_weight_g is null')} as null_weight, {_cnt('seller_hist_late_rate is null')} as null_seller_rate,
       {_cnt('approval_lag_hours is null')} as null_approval_lag
from v_delivery_delay_drivers"""),
    "delay_feature_sanity": ("DELAY", f"""
select {rr('sum(item_count)', 'count(item_count)', 2)} as avg_items,
       {avg_round('order_value', 2, 2)} as avg_order_value,
       {avg_round('avg_product_weight_g', 1, 1)} as avg_weight_g,
       {avg_round('seller_hist_late_rate', 2, 2)} as avg_seller_late_rate,
       {avg_round('approval_lag_hours', 2, 1)} as avg_approval_lag_hrs,
       cast(count(distinct customer_state) as bigint) as distinct_states,
       cast(count(distinct primary_category) as bigint) as distinct_categories
from v_delivery_delay_drivers"""),
    "class_split": ("DELAY", f"""
, cs AS (select is_late, cast(count(*) as bigint) as orders from v_delivery_delay_drivers group by is_late)
select is_late, orders, {rr('orders * 100', '(select sum(orders) from cs)', 2)} as pct from cs"""),
    "delay_outcome_means": ("DELAY", f"""
select {avg_round('case when is_late then seller_hist_late_rate end', 2, 2)} as late_seller_rate,
       {avg_round('case when not is_late then seller_hist_late_rate end', 2, 2)} as ontime_seller_rate,
       {avg_round('case when is_late then approval_lag_hours end', 2, 2)} as late_lag,
       {avg_round('case when not is_late then approval_lag_hours end', 2, 2)} as ontime_lag
from v_delivery_delay_drivers where approval_lag_hours is not null"""),
}

_SAMPLE = f"""
, dds AS (
  select order_id, is_late, approval_lag_hours, item_count, order_value, freight_ratio_pct, seller_hist_late_rate,
         seller_avg_days_to_deliver, customer_state
  from v_delivery_delay_drivers
  where approval_lag_hours is not null and approval_lag_hours <= {P.sample_max_lag_hours}
    and seller_hist_late_rate is not null
  order by {id_bits('order_id', f'sample{P.sample_seed}')}, order_id
  limit {P.sample_size})"""

_ALL = _SAMPLE[:_SAMPLE.index("  order by")].rstrip() + ")"  # all orders of the chart
SQL["delay_driver_sample"] = ("DELAY", _SAMPLE + "\nselect * from dds")


def _box(feat: str) -> str:
    return f"""
select '{feat}' as feature, outcome, n, mean, round(q1, 4) as q1, round(med, 4) as median, round(q3, 4) as q3,
       whisker_low, whisker_high, outliers
from (
  select b.outcome, b.n, b.mean, b.q1, b.med, b.q3,
         min(case when x.v >= b.q1 - (b.q3 - b.q1) * 1.5 then x.v end) as whisker_low,
         max(case when x.v <= b.q3 + (b.q3 - b.q1) * 1.5 then x.v end) as whisker_high,
         cast(count(case when x.v < b.q1 - (b.q3 - b.q1) * 1.5 or x.v > b.q3 + (b.q3 - b.q1) * 1.5 then 1 end)
              as bigint) as outliers
  from (select case when is_late then 'Late' else 'On Time' end as outcome, {feat} as v from dds) x
  join (select case when is_late then 'Late' else 'On Time' end as outcome, cast(count({feat}) as bigint) as n,
               {avg_round(feat, 2, 2)} as mean, quantile_cont({feat}, 0.25) as q1,
               quantile_cont({feat}, 0.5) as med, quantile_cont({feat}, 0.75) as q3
        from dds group by 1) b on x.outcome = b.outcome
  group by b.outcome, b.n, b.mean, b.q1, b.med, b.q3)"""


SQL["delay_by_outcome"] = ("DELAY", _ALL + "\n" + _box("approval_lag_hours") + "\nunion all\n"
                           + _box("seller_hist_late_rate"))

_PAIRS = [(a, b) for i, a in enumerate(CORR_FEATURES) for b in CORR_FEATURES[:i]]
_CORR = f"""
, corr_wide AS (
  select {", ".join(f'corr(cast({a} as double), cast({b} as double)) as "{a}|{b}"' for a, b in _PAIRS)}
  from v_delivery_delay_drivers where approval_lag_hours is not null),
corr_long AS (
  select split_part(k, '|', 1) as feature_a, split_part(k, '|', 2) as feature_b,
         case when isnan(r) then null else round(r, 6) end as r
  from corr_wide unpivot include nulls (r for k in ({", ".join(f'"{a}|{b}"' for a, b in _PAIRS)})))"""
SQL["feature_correlation"] = ("DELAY", _CORR + "\nselect * from corr_long")
SQL["high_correlation_pairs"] = ("DELAY", _CORR + f"""
select feature_a, feature_b, round(r, 3) as r from corr_long
where feature_a <> 'is_late' and feature_b <> 'is_late' and abs(r) > {P.corr_threshold}""")

_UNI_TOTALS = ", ".join(
    ["cast(count(*) as bigint) as \"rows\"", "cast(count(distinct customer_unique_id) as bigint) as people",
     f"{_cnt('segment is null')} as unmatched_rows"]
    + [f"{_cnt(f'{c} is null')} as \"null:{c}\"" for c in UNIFIED_COLS])
SQL["unified_checks"] = ("RFM SLA UNIFIED", f"""
, uc_tot AS (select {_UNI_TOTALS} from v_unified_orders),
uc_long AS (select k as item, v as value from (unpivot uc_tot on columns(*) into name k value v))
select 'people_per_segment' as check_name, coalesce(segment, '<none>') as item,
       cast(count(distinct customer_unique_id) as bigint) as value
from v_unified_orders group by segment
union all
select case when item like 'null:%' then 'nulls' else 'totals' end, regexp_replace(item, '^null:', ''), value
from uc_long where not (item like 'null:%') or value > 0""")

SQL["dash_segments"] = ("RFM SLA UNIFIED", f"""
select segment, cast(count(distinct customer_unique_id) as bigint) as customer_count,
       cast(count(distinct order_id) as bigint) as orders,
       sum({cents('price + freight_value')}) / 100.0 as total_revenue
from v_unified_orders group by segment""")
SQL["dash_revenue_top5"] = ("RFM SLA UNIFIED", f"""
, dr AS (select *, {cents('price + freight_value')} as rev_c from v_unified_orders),
dr_top AS (select product_category_name_english from dr group by 1
           order by sum(rev_c) desc, product_category_name_english asc limit 5)
select order_month, product_category_name_english, sum(rev_c) / 100.0 as total_revenue
from dr where product_category_name_english in (select product_category_name_english from dr_top)
group by order_month, product_category_name_english""")
SQL["dash_sla_top20"] = ("RFM SLA UNIFIED", f"""
select product_category_name_english, {avg_round('category_late_rate_pct', 2, 4)} as avg_category_late_rate_pct,
       min(category_sla_tier) as category_sla_tier
from v_unified_orders where category_late_rate_pct is not null
group by product_category_name_english
order by avg_category_late_rate_pct desc, product_category_name_english asc limit 20""")
SQL["dash_retention"] = ("COHORT", f"""
select cohort_month, period_number, retention_rate_pct from v_cohort_retention where {COHORT_KEPT}""")
SQL["geo_drill"] = ("RFM SLA UNIFIED", f"""
, go AS (select order_id, customer_state, customer_city, sum({cents('price + freight_value')}) as rev_c,
                max(cast(is_late as integer)) as late
         from v_unified_orders group by order_id, customer_state, customer_city)
select case when grouping(customer_state) = 1 then 'total' when grouping(customer_city) = 1 then 'state'
            else 'city' end as level,
       customer_state, customer_city, cast(count(*) as bigint) as orders, sum(rev_c) / 100.0 as total_revenue,
       cast(sum(coalesce(late, 0)) as bigint) as late_orders,
       {rr('sum(coalesce(late, 0)) * 100', 'count(*)', 2)} as late_rate_pct
from go group by rollup (customer_state, customer_city)""")

SQL["ops_seller_kpis"] = ("SELLER", f"""
select cast(count(*) as bigint) as sellers, {avg_round('late_rate_pct', 2, 2)} as avg_late_rate_pct,
       sum({cents('total_revenue')}) / 100.0 as total_revenue,
       {_cnt("seller_risk_tier in ('High Risk', 'Elevated Risk')")} as at_risk_sellers
from v_seller_performance""")
SQL["ops_top20_sellers"] = ("SELLER", """
select seller_id, seller_state, total_orders, late_rate_pct, seller_risk_tier from v_seller_performance
order by late_rate_pct desc, seller_id asc limit 20""")
SQL["ops_volume_vs_late"] = ("SELLER", f"""
select case when total_orders >= 100 then '100+' when total_orders >= 50 then '50-99'
            when total_orders >= 20 then '20-49' else '10-19' end as volume_band,
       cast(count(*) as bigint) as sellers, {avg_round('late_rate_pct', 2, 2)} as avg_late_rate_pct,
       cast(sum(total_orders) as bigint) as orders
from v_seller_performance group by 1""")
SQL["ops_cancel_trend"] = ("MONTHLY_CANCEL", f"""
select * from monthly_cancel
where order_month between '{P.ops_cancel_start.isoformat()[:7]}' and '{P.ops_cancel_end.isoformat()[:7]}'""")
SQL["ops_top15_categories"] = ("CANCEL", """
, names AS (select distinct product_category_name, product_category_name_english from dim_products)
select c.dimension_value as product_category_name, n.product_category_name_english, c.total_orders,
       c.cancelled_orders, c.cancel_rate_pct
from v_cancellation_analysis c left join names n on c.dimension_value = n.product_category_name
where c.analysis_dimension = 'category'
order by c.cancel_rate_pct desc, c.dimension_value asc limit 15""")
SQL["ops_state_table"] = ("CANCEL", """
select dimension_value as state, total_orders, cancelled_orders, cancel_rate_pct
from v_cancellation_analysis where analysis_dimension = 'state'""")
