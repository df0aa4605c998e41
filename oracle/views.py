"""Oracle CTEs of the analytical views, derived from their definitions.

Each view is built from a grain of its own - a visit (order, category), a
stint (seller, order), an active month (person, month) - and weights instead
of row fan-out; windows take the place of self-joins, and quartiles come from
rank arithmetic.  Ratios are rounded exactly (`rr`); every order has a tie
break, so both engines agree.
"""

from __future__ import annotations

from mercato.params import FIXTURE_PARAMS as P
from oracle.base import cents, dlit, rr, slist

DELIVERED = f"order_status = '{P.delivered_status}'"
RELIABLE = f"{DELIVERED} and not has_placeholder_delivery_date"


def _month(ts: str) -> str:
    return f"cast(date_trunc('month', {ts}) as date)"


def _percent(part: str, whole: str) -> str:
    return rr(f"({part}) * 100", whole, 2)


def _ladder(steps: list[tuple[str, str]], last: str) -> str:
    return "case " + " ".join(f"when {cond} then '{name}'" for cond, name in steps) + f" else '{last}' end"


def _sla_tier(rate: str) -> str:
    return _ladder([(f"{rate} >= {P.sla_critical}", "Critical"), (f"{rate} >= {P.sla_below_average}", "Below Average"),
                    (f"{rate} >= {P.sla_average}", "Average")], "Good")


def _risk_tier(rate: str, orders: str) -> str:
    (high, high_n), (raised, raised_n), (strong, strong_n) = P.seller_high_risk, P.seller_elevated_risk, P.seller_strong
    return _ladder([(f"{rate} >= {high} and {orders} >= {high_n}", "High Risk"),
                    (f"{rate} >= {raised} and {orders} >= {raised_n}", "Elevated Risk"),
                    (f"{rate} < {strong} and {orders} >= {strong_n}", "Strong Performer")], "Average")


REVENUE = f"""
basket AS (
  select order_id, any_value({_month('order_purchase_timestamp')}) as order_month, product_category_name as category,
         count(*) as lines, sum(price) as goods, sum(freight_value) as carriage
  from fact_order_items join fact_orders using (order_id) left join dim_products using (product_id)
  where {DELIVERED} group by order_id, product_category_name),
month_category AS (
  select order_month, category, count(*) as orders, sum(lines) as lines, sum(goods) as goods, sum(carriage) as carriage,
         sum(goods) + sum(carriage) as takings, sum(sum(goods) + sum(carriage)) over (partition by order_month) as everything
  from basket group by order_month, category),
v_revenue_by_category AS (
  select order_month, category as product_category_name, cast(orders as bigint) as total_orders, cast(lines as bigint) as total_items,
         cast(goods as double) as product_revenue, cast(carriage as double) as freight_revenue,
         cast(takings as double) as total_revenue, {rr(cents('goods'), 'lines', 0)} / 100.0 as avg_item_price,
         {rr(cents('takings'), 'lines', 0)} / 100.0 as avg_order_value,
         {rr(cents('takings'), 'orders', 0)} / 100.0 as revenue_per_order,
         cast(everything as double) as platform_revenue, {_percent(cents('takings'), cents('everything'))} as revenue_share_pct
  from month_category where category is not null)
"""

SLA = f"""
visit AS (
  select product_category_name as category, order_id, any_value(days_to_deliver) as took, any_value(days_vs_estimate) as off,
         coalesce(bool_or(is_late), false) as late, count(*) as lines
  from fact_order_items join dim_products using (product_id) join fact_orders using (order_id)
  where {RELIABLE} and product_category_name is not null group by product_category_name, order_id),
visit_totals AS (
  select category, count(*) as orders, coalesce(sum(lines) filter (where late), 0) as late_lines, count(*) filter (where late) as late_orders,
         sum(took * lines) as took_sum, sum(lines) filter (where took is not null) as took_n,
         sum(off * lines) as off_sum, sum(lines) filter (where off is not null) as off_n
  from visit group by category having count(*) >= {P.sla_min_orders}),
visit_spread AS (
  select category, quantile_cont(took, [0.5, 0.9]) as took_q, quantile_cont(off, 0.5) as off_q
  from (select category, took, off, unnest(range(lines)) from visit) group by category),
v_category_sla AS (
  select category as product_category_name, cast(orders as bigint) as total_orders, cast(late_lines as bigint) as late_orders,
         {_percent('late_lines', 'orders')} as late_rate_pct, {rr('took_sum', 'took_n', 1)} as avg_days_to_deliver,
         round(cast(took_q[1] as double), 1) as median_days_to_deliver, round(cast(took_q[2] as double), 1) as p90_days_to_deliver,
         {rr('off_sum', 'off_n', 1)} as avg_days_vs_estimate, round(cast(off_q as double), 1) as median_days_vs_estimate,
         {_sla_tier(_percent('late_lines', 'orders'))} as sla_tier, {_percent('visit_totals.late_orders', 'orders')} as order_late_rate_pct
  from visit_totals join visit_spread using (category))
"""

SELLER = f"""
opinion AS (
  select order_id, count(*) as reviews, sum(review_score) as points, count(review_score) as scores from bridge_reviews group by order_id),
stint AS (
  select seller_id, order_id, count(*) as lines, sum(price) + sum(freight_value) as takings from fact_order_items group by seller_id, order_id),
stint_weighed AS (
  select stint.*, lines * greatest(coalesce(reviews, 1), 1) as weight, greatest(coalesce(reviews, 1), 1) as copies, points, scores,
         days_to_deliver as took, days_vs_estimate as off, coalesce(is_late, false) as late
  from stint join fact_orders using (order_id) left join opinion using (order_id) where {RELIABLE}),
seller_totals AS (
  select seller_id, count(*) as orders, sum(weight) as weight, sum(takings * copies) as takings_fanned, sum(takings) as takings,
         coalesce(sum(weight) filter (where late), 0) as late_weight, count(*) filter (where late) as late_count,
         sum(took * weight) as took_sum, sum(weight) filter (where took is not null) as took_n,
         sum(off * weight) as off_sum, sum(weight) filter (where off is not null) as off_n,
         coalesce(sum(points * lines), 0) as points, coalesce(sum(scores * lines), 0) as scores
  from stint_weighed group by seller_id having count(*) >= {P.seller_min_orders}),
v_seller_performance AS (
  select seller_id, seller_city, seller_state, cast(orders as bigint) as total_orders, cast(takings_fanned as double) as total_revenue,
         {rr(cents('takings_fanned'), 'weight', 0)} / 100.0 as avg_order_value, cast(late_weight as bigint) as late_orders,
         {_percent('late_weight', 'orders')} as late_rate_pct, {rr('took_sum', 'took_n', 1)} as avg_days_to_deliver,
         {rr('off_sum', 'off_n', 1)} as avg_days_vs_estimate, {rr('points', 'scores', 2)} as avg_review_score,
         cast(scores as bigint) as reviews_received, {_risk_tier(_percent('late_weight', 'orders'), 'orders')} as seller_risk_tier,
         cast(takings as double) as total_revenue_dedup, {_percent('late_count', 'orders')} as order_late_rate_pct
  from seller_totals join dim_sellers using (seller_id))
"""


def cancellation_ctes(statuses=P.cancel_statuses, prefix: str = "ca") -> str:
    """Month and state from one pass with grouping sets, category from visits."""
    lost = f"order_status in ({slist(statuses)})"
    return f"""
{prefix}_sides AS (
  select 1 - grouping({_month('order_purchase_timestamp')}) as by_month, {_month('order_purchase_timestamp')} as month, customer_state as state,
         count(*) as orders, count(*) filter (where {lost}) as lost
  from fact_orders join dim_customers using (customer_id)
  group by grouping sets (({_month('order_purchase_timestamp')}), (customer_state))),
{prefix}_visits AS (
  select product_category_name as category, order_id, count(*) as lines, bool_or({lost}) as lost
  from fact_orders join fact_order_items using (order_id) join dim_products using (product_id)
  where product_category_name is not null and customer_id in (select customer_id from dim_customers)
  group by product_category_name, order_id),
{prefix}_rows AS (
  select case by_month when 1 then 'monthly' else 'state' end as dimension,
         case by_month when 1 then cast(month as varchar) else state end as member, orders, lost, lost as lost_orders
  from {prefix}_sides
  where orders >= case by_month when 1 then {P.cancel_min_orders_month} else {P.cancel_min_orders_state} end
  union all
  select 'category', category, count(*), coalesce(sum(lines) filter (where lost), 0), count(*) filter (where lost)
  from {prefix}_visits group by category having count(*) >= {P.cancel_min_orders_category}),
{prefix}_view AS (
  select dimension as analysis_dimension, member as dimension_value, cast(orders as bigint) as total_orders,
         cast(lost as bigint) as cancelled_orders, {_percent('lost', 'orders')} as cancel_rate_pct,
         cast(null as varchar) as secondary_dimension, {_percent('lost_orders', 'orders')} as order_cancel_rate_pct
  from {prefix}_rows)
"""


CANCEL = cancellation_ctes() + ",\nv_cancellation_analysis AS (select * from ca_view)"

COHORT = f"""
active_month AS (
  select distinct customer_unique_id as person, {_month('order_purchase_timestamp')} as month
  from fact_orders join dim_customers using (customer_id)
  where order_status not in ({slist(P.cancel_statuses)})),
aged_month AS (
  select person, min(month) over (partition by person) as cohort_month, month from active_month),
cohort_cell AS (
  select cohort_month, cast(date_diff('month', cohort_month, month) as integer) as period_number, count(*) as people
  from aged_month group by all),
v_cohort_retention AS (
  select cohort_month, cast(size as bigint) as cohort_size, period_number, cast(people as bigint) as active_customers,
         {_percent('people', 'size')} as retention_rate_pct, {rr('people', 'size', 4)} as retention_rate
  from (select *, first_value(people) over (partition by cohort_month order by period_number) as size from cohort_cell)
  where cohort_month between {dlit(P.cohort_start)} and {dlit(P.cohort_end)})
"""

_TIE = "customer_unique_id, customer_city nulls first, customer_state nulls first"


def _quarter(place: str) -> str:
    """Quartile of a 1-based place among ``n``: the first n % 4 quartiles hold one more."""
    return (f"cast(case when {place} <= (n % 4) * (n // 4 + 1) then ({place} + n // 4) // (n // 4 + 1) "
            f"else n % 4 + ({place} - (n % 4) * (n // 4 + 1) + n // 4 - 1) // (n // 4) end as integer)")


# fixed values: the segment ladder, first match wins
_SEGMENT = _ladder([
    ("least(r_score, f_score, m_score) >= 3", "Champions"),
    ("r_score >= 3 and f_score >= 2", "Loyal Customers"),
    ("r_score >= 3 and f_score = 1", "Potential Loyalists"),
    ("r_score = 2 and f_score >= 3", "At Risk"),
    ("r_score = 1 and f_score >= 3", "Cannot Lose Them"),
    ("r_score = 2 and f_score = 2", "Needs Attention"),
    ("r_score = 1 and f_score = 2", "Hibernating"),
], "Lost")

RFM = f"""
spending AS (
  select customer_unique_id, customer_city, customer_state, count(*) as frequency, sum(payment_value) as monetary,
         max(cast(order_purchase_timestamp as date)) as last_order_date
  from bridge_payments join fact_orders using (order_id) join dim_customers using (customer_id)
  where {DELIVERED} group by customer_unique_id, customer_city, customer_state),
spending_places AS (
  select *, count(*) over () as n, row_number() over (order by last_order_date nulls first, {_TIE}) as r_place,
         row_number() over (order by frequency, {_TIE}) as f_place,
         row_number() over (order by monetary nulls first, {_TIE}) as m_place
  from spending),
spending_scores AS (
  select *, {_quarter('r_place')} as r_score, {_quarter('f_place')} as f_score, {_quarter('m_place')} as m_score from spending_places),
v_rfm_scores AS (
  select customer_unique_id, customer_city, customer_state,
         cast(date_diff('day', last_order_date, {dlit(P.rfm_reference_date)}) as integer) as recency_days,
         cast(frequency as bigint) as frequency, cast(monetary as double) as monetary, last_order_date,
         r_score, f_score, m_score, cast(r_score + f_score + m_score as integer) as rfm_total, {_SEGMENT} as segment
  from spending_scores)
"""

DELAY = f"""
cart AS (
  select order_id, count(*) as lines, count(distinct seller_id) as sellers, sum(price) as goods, sum(freight_value) as carriage,
         count(price) as priced, min(seller_id) filter (where order_item_id = 1) as lead_seller,
         sum(product_weight_g) as weight, count(product_weight_g) as weighed,
         sum(coalesce(product_length_cm, 0) * coalesce(product_height_cm, 0) * coalesce(product_width_cm, 0)) as volume
  from fact_order_items join dim_products using (product_id) group by order_id),
cart_share AS (
  select order_id, product_category_name as category, count(*) as lines, max(count(*)) over (partition by order_id) as most
  from fact_order_items join dim_products using (product_id)
  where product_category_name is not null group by order_id, product_category_name),
cart_theme AS (select order_id, min(category) as category from cart_share where lines = most group by order_id),
record_stint AS (
  select seller_id, order_id, count(*) as lines, bool_or(is_late) as late, any_value(days_to_deliver) as took
  from fact_order_items join fact_orders using (order_id) where {RELIABLE} group by seller_id, order_id),
record AS (
  select seller_id, cast(count(*) as bigint) as orders, {_percent('coalesce(sum(lines) filter (where late), 0)', 'sum(lines)')} as late_rate,
         {rr('sum(took * lines)', 'sum(lines) filter (where took is not null)', 1)} as took
  from record_stint group by seller_id),
v_delivery_delay_drivers AS (
  select order_id, is_late, cast(extract(dow from order_purchase_timestamp) as integer) as order_day_of_week,
         cast(extract(hour from order_purchase_timestamp) as integer) as order_hour,
         cast(extract(month from order_purchase_timestamp) as integer) as order_month_num,
         cast(cart.lines as bigint) as item_count, cast(sellers as bigint) as seller_count, cast(goods as double) as order_value,
         cast(carriage as double) as freight_value, {rr(cents('goods'), 'priced', 0)} / 100.0 as avg_item_price,
         {_percent(cents('carriage'), cents('goods'))} as freight_ratio_pct,
         {rr(cents('weight'), 'weighed * 100', 1)} as avg_product_weight_g,
         {rr(cents('volume', 6), 'cart.lines * 1000000', 1)} as avg_product_volume_cm3, cart_theme.category as primary_category,
         record.late_rate as seller_hist_late_rate, record.took as seller_avg_days_to_deliver, record.orders as seller_total_orders,
         customer_state, cast(approval_lag_hours as double) as approval_lag_hours
  from fact_orders join cart using (order_id) join record on seller_id = lead_seller join dim_customers using (customer_id)
       left join cart_theme using (order_id)
  where {RELIABLE} and has_items and has_payment)
"""

UNIFIED = f"""
person_score AS (
  select distinct on (customer_unique_id) * from v_rfm_scores
  order by customer_unique_id, last_order_date desc, monetary desc, customer_city, customer_state),
purchase AS (
  select fact_orders.*, dim_customers.customer_unique_id, dim_customers.customer_city, dim_customers.customer_state,
         segment, r_score, f_score, m_score, rfm_total, recency_days, frequency, monetary
  from fact_orders join dim_customers using (customer_id)
       left join person_score on person_score.customer_unique_id = dim_customers.customer_unique_id
  where {DELIVERED}),
v_unified_orders AS (
  select customer_unique_id, customer_city, customer_state, segment, r_score, f_score, m_score, rfm_total, recency_days, frequency, monetary,
         order_id, {_month('order_purchase_timestamp')} as order_month,
         cast(extract(year from order_purchase_timestamp) as integer) as order_year,
         cast(extract(month from order_purchase_timestamp) as integer) as order_month_num, order_status, is_late,
         cast(days_to_deliver as double) as days_to_deliver, cast(days_vs_estimate as double) as days_vs_estimate, order_item_id,
         cast(price as double) as price, cast(freight_value as double) as freight_value,
         dim_products.product_category_name, product_category_name_english, late_rate_pct as category_late_rate_pct,
         avg_days_to_deliver as category_avg_days_to_deliver, p90_days_to_deliver as category_p90_days_to_deliver,
         sla_tier as category_sla_tier, avg_days_vs_estimate as category_avg_days_vs_estimate
  from fact_order_items join purchase using (order_id) join dim_products using (product_id)
       left join v_category_sla on v_category_sla.product_category_name = dim_products.product_category_name)
"""
