"""Oracle SQL for the data-quality keys, the as-of seller history and the
EDA sanity table."""

from __future__ import annotations

from mercato.params import FIXTURE_PARAMS as P
from oracle.base import cents, dlit, id_bits, rr
from oracle.reports import CORR_FEATURES, avg_round, sum_round

RAW_COLUMNS = {
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"],
    "items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
              "freight_value"],
    "payments": ["order_id", "payment_type", "payment_installments", "payment_value"],
    "reviews": ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
                "review_creation_date", "review_answer_timestamp"],
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                  "customer_state"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "products": ["product_id", "product_category_name", "product_weight_g", "product_length_cm",
                 "product_height_cm", "product_width_cm"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city",
                    "geolocation_state"],
    "translation": ["product_category_name", "product_category_name_english"],
}


def _cnt(cond: str) -> str:
    return f"cast(count(case when {cond} then 1 end) as bigint)"


def _dtype(c: str) -> str:
    """The type's published name, from the engine's own."""
    return (f"max(case typeof({c}) when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' "
            f"when 'INTEGER' then 'int' else lower(typeof({c})) end)")


def _profile_one(t: str, cols: list[str]) -> str:
    rows = f"(select count(*) from raw_{t})"
    dups = f"(select count(*) from raw_{t}) - (select count(*) from (select distinct * from raw_{t}))"
    return "\nunion all\n".join(
        f"select '{t}' as table_name, '{c}' as column_name, {_dtype(c)} as dtype, cast({rows} as bigint) as rows, "
        f"cast({len(cols)} as integer) as columns, cast({dups} as bigint) as duplicate_rows, "
        f"cast(count(*) filter (where {c} is null) as bigint) as nulls, "
        f"{rr(f'count(*) filter (where {c} is null) * 100', 'count(*)', 2)} as null_pct, "
        f"cast(count(distinct {c}) as bigint) as distinct_values from raw_{t}"
        for c in cols)


SQL: dict[str, tuple[str, str]] = {}

SQL["profile_tables"] = ("", "\nunion all\n".join(_profile_one(t, c) for t, c in RAW_COLUMNS.items()))


def _anti(child: str, parent: str, ck: str, pk: str | None = None, where: str = "") -> str:
    pk = pk or ck
    w = f" and {where}" if where else ""
    return (f"(select cast(count(*) as bigint) from {child} c where not exists "
            f"(select 1 from {parent} p where p.{pk} = c.{ck}){w})")


SQL["key_integrity"] = ("", "\nunion all\n".join(
    f"select '{name}' as relation, {expr} as orphans" for name, expr in [
        ("orders -> customers", _anti("raw_orders", "raw_customers", "customer_id")),
        ("order_items -> orders", _anti("raw_items", "raw_orders", "order_id")),
        ("order_items -> products", _anti("raw_items", "raw_products", "product_id")),
        ("order_items -> sellers", _anti("raw_items", "raw_sellers", "seller_id")),
        ("payments -> orders", _anti("raw_payments", "raw_orders", "order_id")),
        ("reviews -> orders", _anti("raw_reviews", "raw_orders", "order_id")),
        ("orders without items", _anti("raw_orders", "raw_items", "order_id")),
        ("orders without payments", _anti("raw_orders", "raw_payments", "order_id")),
        ("products without English category",
         _anti("raw_products", "raw_translation", "product_category_name",
               where="c.product_category_name is not null")),
    ]))

SQL["ghost_orders"] = ("", """
select order_status, cast(count(*) as bigint) as orders from raw_orders o
where not exists (select 1 from raw_items i where i.order_id = o.order_id) group by order_status""")

SQL["unmapped_categories"] = ("", """
select product_category_name, cast(count(*) as bigint) as products from raw_products p
where product_category_name is not null
  and not exists (select 1 from raw_translation t where t.product_category_name = p.product_category_name)
group by product_category_name""")

_PKS = [
    ("dim_customers", ["customer_id"]), ("dim_sellers", ["seller_id"]), ("dim_products", ["product_id"]),
    ("dim_geolocation", ["zip_code_prefix"]), ("fact_orders", ["order_id"]),
    ("fact_order_items", ["order_id", "order_item_id"]), ("bridge_payments", ["order_id"]),
    ("bridge_reviews", ["review_id"]),
]


def _cv(table: str, name: str, expr: str) -> str:
    return f"select '{table}' as table_name, '{name}' as constraint_name, cast({expr} as bigint) as violations"


def _fk(child: str, parent: str, ck: str, pk: str) -> str:
    return (f"(select count(*) from {child} c where c.{ck} is not null and not exists "
            f"(select 1 from {parent} p where p.{pk} = c.{ck}))")


_CV = (
    [_cv(t, "primary key " + ",".join(k),
         f"(select coalesce(sum(n - 1), 0) from (select count(*) as n from {t} group by {', '.join(k)}) "
         f"where n > 1)") for t, k in _PKS]
    + [_cv(t, f"not null {c}", f"(select count(*) from {t} where {c} is null)") for t, ks in _PKS for c in ks]
    + [
        _cv("dim_customers", "not null customer_unique_id",
            "(select count(*) from dim_customers where customer_unique_id is null)"),
        _cv("bridge_reviews", "check review_score between 1 and 5",
            "(select count(*) from bridge_reviews where not (review_score between 1 and 5))"),
        _cv("fact_orders", "foreign key customer_id", _fk("fact_orders", "dim_customers", "customer_id",
                                                           "customer_id")),
        _cv("fact_order_items", "foreign key order_id", _fk("fact_order_items", "fact_orders", "order_id",
                                                             "order_id")),
        _cv("fact_order_items", "foreign key product_id", _fk("fact_order_items", "dim_products", "product_id",
                                                               "product_id")),
        _cv("fact_order_items", "foreign key seller_id", _fk("fact_order_items", "dim_sellers", "seller_id",
                                                              "seller_id")),
        _cv("bridge_payments", "foreign key order_id", _fk("bridge_payments", "fact_orders", "order_id",
                                                            "order_id")),
        _cv("bridge_reviews", "foreign key order_id", _fk("bridge_reviews", "fact_orders", "order_id", "order_id")),
    ]
)
SQL["constraint_violations"] = ("", "\nunion all\n".join(_CV))

SQL["row_count_report"] = ("", "\nunion all\n".join(
    f"select '{t}' as table_name, expected, loaded, case when expected = loaded then 'OK' else 'MISMATCH' end as status "
    f"from (select cast(count(*) as bigint) as expected, cast(count({', '.join(k) if len(k) == 1 else '*'}) as bigint) as loaded from {t})"
    for t, k in _PKS))

SQL["duplicate_review_ids"] = ("", """
select review_id, cast(count(*) as bigint) as copies from raw_reviews group by review_id having count(*) > 1""")

SQL["duplicate_review_rows"] = ("", """
select * from raw_reviews where review_id in (select review_id from raw_reviews group by review_id having count(*) > 1)""")

SQL["zip_prefix_stats"] = ("", f"""
select cast(count(*) as bigint) as unique_zip_prefixes, cast(sum(n) as bigint) as total_rows,
       {rr('sum(n)', 'count(*)', 1)} as avg_rows_per_prefix, cast(max(n) as bigint) as max_rows_per_prefix
from (select geolocation_zip_code_prefix, count(*) as n from raw_geolocation group by 1)""")

SQL["items_per_order"] = ("", """
select items, cast(count(*) as bigint) as orders
from (select order_id, max(order_item_id) as items from raw_items group by order_id) group by items""")

SQL["geo_outliers"] = ("", f"""
select cast(count(*) as bigint) as count, min(geolocation_lat) as lat_min, max(geolocation_lat) as lat_max,
       min(geolocation_lng) as lng_min, max(geolocation_lng) as lng_max
from raw_geolocation
where not (geolocation_lat between {P.profile_box_lat[0]} and {P.profile_box_lat[1]}
           and geolocation_lng between {P.profile_box_lng[0]} and {P.profile_box_lng[1]})""")

_D = "floor(date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) / 86400000000.0)"
SQL["delivery_anomalies"] = ("", f"""
select (select {_cnt(f'{_D} < 0')} from raw_orders) as negative_days_raw,
       (select {_cnt(f'{_D} > {P.max_delivery_days}')} from raw_orders) as over_max_days_raw,
       {_cnt('days_to_deliver < 0')} as negative_days_clean,
       {_cnt(f'days_to_deliver > {P.max_delivery_days}')} as over_max_days_clean,
       {_cnt('days_to_deliver = 0')} as same_day
from fact_orders""")

SQL["long_deliveries"] = ("", f"""
select order_id, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
       order_delivered_customer_date, order_estimated_delivery_date, days_to_deliver, days_vs_estimate, is_late
from fact_orders where days_to_deliver > {P.max_delivery_days}""")

_CLEAN = (f"order_status = '{P.delivered_status}' and not has_placeholder_delivery_date and is_late is not null")
SQL["placeholder_report"] = ("", "\nunion all\n".join(
    [f"select 'delivered_on_{d.isoformat()}' as metric, "
     f"{_cnt(f"order_status = '{P.delivered_status}' and cast(order_delivered_customer_date as date) = {dlit(d)}")}"
     f" as value from fact_orders" for d in P.placeholder_dates]
    + [f"select '{m}', {_cnt(c)} from fact_orders" for m, c in [
        ("placeholder_orders", "has_placeholder_delivery_date"),
        ("no_delivery_date", "order_delivered_customer_date is null"),
        ("days_to_deliver_nulls", "days_to_deliver is null"),
        ("days_vs_estimate_nulls", "days_vs_estimate is null"),
        ("is_late_nulls", "is_late is null"),
        ("clean_delivered", _CLEAN),
        ("clean_late", f"{_CLEAN} and is_late"),
    ]]))

_BOX = (f"geolocation_lat between {P.box_lat[0]} and {P.box_lat[1]} "
        f"and geolocation_lng between {P.box_lng[0]} and {P.box_lng[1]}")


def _step(step: str, metric: str, before: str, after: str) -> str:
    return (f"select '{step}' as step, '{metric}' as metric, cast(({before}) as bigint) as before, "
            f"cast(({after}) as bigint) as after")


_STEPS = [
    _step("geolocation", "rows: exact duplicates dropped", "select count(*) from raw_geolocation",
          "select count(*) from (select distinct * from raw_geolocation)"),
    _step("geolocation", "rows: outside box dropped", "select count(*) from (select distinct * from raw_geolocation)",
          f"select count(*) from (select distinct * from raw_geolocation) where {_BOX}"),
    _step("geolocation", "rows: one per zip prefix",
          f"select count(*) from (select distinct * from raw_geolocation) where {_BOX}",
          "select count(*) from dim_geolocation"),
    _step("reviews", "rows: duplicate review ids dropped", "select count(*) from raw_reviews",
          "select count(*) from bridge_reviews"),
    _step("payments", "rows: not_defined dropped", "select count(*) from raw_payments",
          "select count(*) from pay_kept"),
    _step("payments", "rows: one per order", "select count(*) from pay_kept", "select count(*) from bridge_payments"),
    _step("products", "english name nulls",
          "select count(*) from raw_products p left join raw_translation t "
          "on p.product_category_name = t.product_category_name where t.product_category_name_english is null",
          "select count(*) from dim_products where product_category_name_english is null"),
] + [
    _step("products", f"{c} nulls", f"select count(*) from raw_products where {c} is null",
          f"select count(*) from dim_products where {c} is null")
    for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
]
SQL["cleaning_steps"] = ("", "\nunion all\n".join(_STEPS))

SQL["extract_reconciliation"] = ("RFM SLA UNIFIED", f"""
, ra AS (select distinct customer_unique_id, segment from v_rfm_scores),
rb AS (select distinct customer_unique_id, segment from v_unified_orders where segment is not null),
rj AS (select coalesce(ra.customer_unique_id, rb.customer_unique_id) as p, coalesce(ra.segment, rb.segment) as segment,
              ra.customer_unique_id is not null as in_a, rb.customer_unique_id is not null as in_b
       from ra full outer join rb on ra.customer_unique_id = rb.customer_unique_id and ra.segment = rb.segment)
select segment, {_cnt('in_a')} as view_customers, {_cnt('in_b')} as unified_customers,
       {_cnt('in_a and not in_b')} as in_view_not_unified, {_cnt('in_b and not in_a')} as in_unified_not_view
from rj group by segment""")

SQL["extract_difference_sample"] = ("RFM SLA UNIFIED", """
, ra AS (select distinct customer_unique_id, segment from v_rfm_scores),
rb AS (select distinct customer_unique_id, segment from v_unified_orders where segment is not null)
select * from (
  select *, 'view' as only_in from (select * from ra except select * from rb)
  union all select *, 'unified' as only_in from (select * from rb except select * from ra))
order by customer_unique_id, segment limit 20""")

SQL["seller_history_asof"] = ("", f"""
, ah_rows AS (
  select foi.seller_id, fo.order_id, fo.order_purchase_timestamp, count(*) as n,
         sum(case when fo.is_late then 1 else 0 end) as l, coalesce(sum(fo.days_to_deliver), 0) as sd, count(fo.days_to_deliver) as cd
  from fact_orders fo join fact_order_items foi on fo.order_id = foi.order_id
  where fo.order_status = '{P.delivered_status}' and fo.has_placeholder_delivery_date = false
  group by foi.seller_id, fo.order_id, fo.order_purchase_timestamp),
ah AS (
  select seller_id, order_id, order_purchase_timestamp,
    count(*) over w - count(*) over t as o,
    sum(n) over w - sum(n) over t as r, sum(l) over w - sum(l) over t as l,
    coalesce(sum(sd) over w, 0) - coalesce(sum(sd) over t, 0) as sd, sum(cd) over w - sum(cd) over t as cd
  from ah_rows
  window w as (partition by seller_id order by order_purchase_timestamp
               range between unbounded preceding and current row),
         t as (partition by seller_id, order_purchase_timestamp))
select seller_id, order_id, order_purchase_timestamp, cast(o as bigint) as seller_prior_orders,
       {rr('l * 100', 'r', 2)} as seller_prior_late_rate, {rr('sd', 'cd', 1)} as seller_prior_avg_days_to_deliver
from ah""")

_EXCL = ", ".join(f"'{d.isoformat()}'" for d in P.cancel_exclude_months)
_COHORT_KEPT = f"cohort_month not in ({', '.join(dlit(d) for d in P.cohort_exclude)}) and period_number > 0"
_FEATS = " + ".join(f"count(*) filter (where {c} is null)" for c in CORR_FEATURES)
_SANITY = [
    ("rfm_customers", "count(*)", "v_rfm_scores"),
    ("rfm_revenue", sum_round("monetary", 2, 0), "v_rfm_scores"),
    ("cohorts", "count(distinct cohort_month)", f"v_cohort_retention where {_COHORT_KEPT}"),
    ("max_retention_pct_after_period0", "max(retention_rate_pct)", f"v_cohort_retention where {_COHORT_KEPT}"),
    ("revenue_months", "count(*)", "es_m"),
    ("peak_month_revenue", rr("max(rev_c)", "100", 0), "es_m"),
    ("total_revenue", rr("sum(rev_c)", "100", 0), "es_m"),
    ("critical_categories", "count(*)",
     f"v_category_sla where sla_tier = 'Critical' and total_orders >= {P.sla_min_orders}"),
    ("worst_category_late_rate_pct", "max(late_rate_pct)", "v_category_sla"),
    ("categories_min_orders_scatter", "count(*)", f"v_category_sla where total_orders >= {P.revenue_vs_late_min_orders}"),
    ("sellers_min_orders", "count(*)", f"v_seller_performance where total_orders >= {P.seller_min_orders}"),
    ("max_monthly_cancel_rate_pct", "max(cancel_rate_pct)",
     f"v_cancellation_analysis where analysis_dimension = 'monthly' and dimension_value not in ({_EXCL})"),
    ("worst_state_cancel_rate_pct", "max(cancel_rate_pct)", "v_cancellation_analysis where analysis_dimension = 'state'"),
    ("seller_rate_late", avg_round("case when is_late then seller_hist_late_rate end", 2, 2), "es_lag"),
    ("seller_rate_ontime", avg_round("case when not is_late then seller_hist_late_rate end", 2, 2), "es_lag"),
    ("approval_lag_late", avg_round("case when is_late then approval_lag_hours end", 2, 2), "es_lag"),
    ("approval_lag_ontime", avg_round("case when not is_late then approval_lag_hours end", 2, 2), "es_lag"),
    ("feature_rows", "count(*)", "es_lag"),
    ("feature_nulls", _FEATS, "es_lag"),
]


def _expected(metric: str) -> str:
    known = {m: (e, t) for m, e, t in P.expected_figures}
    e, t = known.get(metric, ("null", "null"))
    return f"cast({e} as double) as expected, cast({t} as double) as tolerance"


SQL["eda_sanity"] = ("RFM COHORT REVENUE SLA SELLER CANCEL DELAY", f"""
, es_m AS (select order_month, sum({cents('total_revenue')}) as rev_c from v_revenue_by_category group by order_month),
es_lag AS (select * from v_delivery_delay_drivers where approval_lag_hours is not null)
select metric, value, expected, case when expected is null then 'NOT SET' when abs(value - expected) <= tolerance then 'OK'
       else 'DIFFERS' end as result from (
""" + "\nunion all\n".join(
    f"select '{m}' as metric, cast(({e}) as double) as value, {_expected(m)} from {src}" for m, e, src in _SANITY) + ")")

# ------------------------------------------------------------ SQL-expressible ML steps
_NUM = ["order_day_of_week", "order_hour", "order_month_num", "item_count", "seller_count", "order_value",
        "freight_value", "freight_ratio_pct", "avg_product_weight_g", "avg_product_volume_cm3",
        "seller_hist_late_rate", "seller_avg_days_to_deliver", "seller_total_orders", "approval_lag_hours"]
# the seller's record before the order in place of its record over all time
_ASOF = {"seller_hist_late_rate": "coalesce(past.rate, 0)", "seller_avg_days_to_deliver": "coalesce(past.took, 0)",
         "seller_total_orders": "coalesce(past.o, 0)"}
_MLF = f"""
, mlf AS (
  select order_id, cast(is_late as integer) as label, {", ".join(f"cast({c} as double) as {c}" for c in _NUM)},
         customer_state, coalesce(primary_category, '{P.ml_unknown_category}') as primary_category
  from v_delivery_delay_drivers where approval_lag_hours is not null)"""
SQL["ml_features"] = ("DELAY", _MLF + "\nselect * from mlf")
SQL["ml_null_category_rate"] = ("DELAY", f"""
select primary_category is null as no_category, cast(count(*) as bigint) as orders, {_cnt('is_late')} as late_orders,
       {rr("count(*) filter (where is_late) * 100", "count(*)", 2)} as late_rate_pct
from v_delivery_delay_drivers where approval_lag_hours is not null group by 1""")
SQL["ml_split_summary"] = ("DELAY", _MLF + f"""
, place as (select label, {id_bits('order_id', f'split{P.seed}')} >> 36 as bucket from mlf),
upto as (select label, bucket, count(*) over (partition by label order by bucket) as upto, count(*) over (partition by label) as total from place),
cut as (select label, coalesce(max(bucket) filter (where upto <= round(total * {P.test_fraction})), -1) as cut from upto group by label)
select case when bucket <= cut then 'test' else 'train' end as split, label, cast(count(*) as bigint) as rows
from place join cut using (label) group by 1, 2""")
SQL["ml_features_asof"] = ("DELAY", SQL["seller_history_asof"][1].rstrip()[:SQL["seller_history_asof"][1].rindex("select seller_id")] + f"""
, past as (
  select seller_id, order_id, {rr('l * 100', 'r', 2)} as rate, {rr('sd', 'cd', 1)} as took, o from ah)
select d.order_id, cast(d.is_late as integer) as label,
       {", ".join(f"cast({_ASOF.get(c, 'd.' + c)} as double) as {c}" for c in _NUM)},
       d.customer_state, coalesce(d.primary_category, '{P.ml_unknown_category}') as primary_category
from v_delivery_delay_drivers d join fact_order_items i on i.order_id = d.order_id and i.order_item_id = 1
     left join past on past.order_id = d.order_id and past.seller_id = i.seller_id
where d.approval_lag_hours is not null""")
_RATE = _MLF + f"""
, rs as (select order_id, label, seller_hist_late_rate / 100 as p_late, cast(seller_hist_late_rate / 100 >= {P.rate_threshold} as integer) as flag
         from mlf where seller_hist_late_rate is not null),
rc as (select p_late as threshold, sum(label) as pos, count(*) as n from rs group by p_late),
rt as (select threshold, pos, n, sum(pos) over (order by threshold desc) as tp, sum(n) over (order by threshold desc) as flagged,
              sum(pos) over () as p, sum(n) over () as a from rc),
curve as (select threshold, tp / flagged as precision, tp / p as recall,
                 2 * (tp / flagged) * (tp / p) / (tp / flagged + tp / p + 1e-9) as f1, tp / p as tpr, (flagged - tp) / (a - p) as fpr from rt)"""
SQL["ml_rate_curve"] = ("DELAY", _RATE + "\nselect * from curve")
SQL["ml_rate_best_threshold"] = ("DELAY", _RATE + """
select threshold, precision, recall, f1 from curve order by f1 desc, threshold desc limit 1""")
SQL["ml_rate_confusion"] = ("DELAY", _RATE + """
select label, flag as prediction, cast(count(*) as bigint) as count from rs group by label, flag""")
SQL["ml_rate_report"] = ("DELAY", _RATE + """
, c as (select count(*) filter (where label = 1 and flag = 1) as tp, count(*) filter (where label = 0 and flag = 1) as fp,
               count(*) filter (where label = 1 and flag = 0) as fn, count(*) filter (where label = 0 and flag = 0) as tn from rs),
sides as (select 'Late' as class, tp as hit, fp as wrong, fn as missed, tp, fp, fn, tn from c
          union all select 'On Time', tn, fn, fp, tp, fp, fn, tn from c),
pr as (select *, case when hit + wrong > 0 then hit / (hit + wrong) else 0.0 end as precision,
              case when hit + missed > 0 then hit / (hit + missed) else 0.0 end as recall from sides)
select class, cast(precision as double) as precision, cast(recall as double) as recall,
       cast(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as double) as f1,
       cast(hit + missed as bigint) as support, (tp + tn) / (tp + tn + fp + fn) as accuracy,
       (select round(sum((n - pos) * (tp - pos / 2)) / (max(p) * max(a - p)), 9) from rt) as auc
from pr""")
_BIN = " + ".join(f"cast(seller_hist_late_rate >= {e} as integer)" for e in P.drift_edges)
SQL["ml_seller_rate_psi"] = ("DELAY", _MLF + f"""
, psi_h AS (
  select {_BIN} as bin,
         count(case when o.order_purchase_timestamp < {dlit(P.temporal_cutoff)} then 1 end) as e,
         count(case when o.order_purchase_timestamp >= {dlit(P.temporal_cutoff)} then 1 end) as a
  from mlf m join fact_orders o on m.order_id = o.order_id
  where seller_hist_late_rate is not null group by 1),
psi_p AS (select greatest(e / (select sum(e) from psi_h), 1e-6) as pe,
                 greatest(a / (select sum(a) from psi_h), 1e-6) as pa from psi_h)
select round(sum((pa - pe) * ln(pa / pe)), 6) as psi from psi_p""")


# ------------------------------------------------------------ describe / value counts / 2B
def _describe(src: str, cols: list[str]) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as column_name, cast(count({c}) as bigint) as count, "
        f"round(avg(cast({c} as double)), 6) as mean, round(stddev_samp(cast({c} as double)), 6) as std, "
        f"min(cast({c} as double)) as min, round(quantile_cont(cast({c} as double), 0.25), 6) as p25, "
        f"round(quantile_cont(cast({c} as double), 0.5), 6) as p50, "
        f"round(quantile_cont(cast({c} as double), 0.75), 6) as p75, max(cast({c} as double)) as max from {src}"
        for c in cols)


def _vc(src: str, col: str, dropna: bool = True, top: int | None = None) -> str:
    where = f" where {col} is not null" if dropna else ""
    q = f"select {col} as value, cast(count(*) as bigint) as count from {src}{where} group by {col}"
    if top is not None:
        q += f" order by count desc, value asc nulls first limit {top}"
    return q


SQL["delivery_describe"] = ("", _describe("fact_orders", ["days_to_deliver", "days_vs_estimate",
                                                          "approval_lag_hours"]))
SQL["money_describe"] = ("", _describe("fact_order_items", ["price", "freight_value"]) + "\nunion all\n"
                         + _describe("raw_payments", ["payment_value"]))
SQL["order_status_counts"] = ("", _vc("raw_orders", "order_status"))
SQL["payment_type_counts"] = ("", _vc("raw_payments", "payment_type"))
SQL["installments_top10"] = ("", _vc("raw_payments", "payment_installments", top=10))
SQL["review_score_counts"] = ("", _vc("raw_reviews", "review_score"))
SQL["category_counts"] = ("", _vc("raw_products", "product_category_name", dropna=False, top=5))
SQL["cohort_period0"] = ("COHORT", """
select cohort_month, cohort_size, retention_rate_pct from v_cohort_retention where period_number = 0""")
