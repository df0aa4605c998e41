"""DuckDB oracle: the fixture lens and the star schema as SQL CTEs.

Written independently of the DataFrame code.  Every oracle query is
``WITH <lens>, <star>, <query CTEs> SELECT ...`` over the driver's tables.
Ordering clauses always name NULLS FIRST/LAST, because the engines differ in
their defaults.
"""

from __future__ import annotations

from mercato.params import FIXTURE_PARAMS as P


def rr(num: str, den: str, digits: int) -> str:
    """round(num/den, digits) half away from zero, exact for integer inputs (double)."""
    s = 10**digits
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    q = f"((2 * abs({n}) * {s} + {d}) // (2 * {d}))"
    return f"(CASE WHEN {d} <> 0 THEN (CASE WHEN {n} < 0 THEN -{q} ELSE {q} END) / {float(s)} END)"


def cents(x: str, scale: int = 2) -> str:
    return f"CAST(round(({x}) * {10**scale}) AS HUGEINT)"


def id_bits(x: str, salt) -> str:
    """52 bits of the salted MD5 of an id's text form."""
    return f"cast('0x' || substr(md5(cast({x} as varchar) || ':{salt}'), 1, 13) as bigint)"


def dlit(d) -> str:
    return f"DATE '{d.isoformat()}'"


def dlist(ds) -> str:
    return ", ".join(dlit(d) for d in ds)


def slist(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


LENS = """
raw_customers AS (
  select c_custkey as customer_id, cast(floor(c_custkey / 2) as bigint) as customer_unique_id,
         c_nationkey as customer_zip_code_prefix, c_mktsegment as customer_city, n_name as customer_state
  from customer join nation on c_nationkey = n_nationkey),
raw_sellers AS (
  select s_suppkey as seller_id, s_nationkey as seller_zip_code_prefix,
         concat('CITY_', cast(s_suppkey % 7 as varchar(10))) as seller_city, n_name as seller_state
  from supplier join nation on s_nationkey = n_nationkey),
raw_products AS (
  select p_partkey as product_id,
         case when p_partkey % 67 = 5 then null else concat(p_type, '_', p_brand) end as product_category_name,
         case when p_partkey % 41 = 3 then null else cast(p_size * 100 as double) end as product_weight_g,
         cast(p_size + 5 as double) as product_length_cm,
         cast(p_partkey % 30 + 2 as double) as product_height_cm,
         case when p_partkey % 53 = 9 then null else cast(p_partkey % 25 + 6 as double) end as product_width_cm
  from part),
raw_translation AS (
  select distinct concat(p_type, '_', p_brand) as product_category_name,
         lower(concat(p_brand, '_', p_type)) as product_category_name_english
  from part where p_type <> 'PROMO'),
raw_items AS (
  select l_orderkey as order_id,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate,
              l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as integer) as order_item_id,
         l_partkey as product_id, l_suppkey as seller_id, l_shipdate as shipping_limit_date,
         cast(l_extendedprice as decimal(12,2)) as price,
         cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)), 2) as decimal(12,2)) as freight_value
  from lineitem),
lens_sh AS (
  select l_orderkey, max(l_shipdate) as last_ship, min(l_suppkey) as first_supplier,
         max(case p_type when 'LARGE' then 5 when 'ECONOMY' then 3 when 'PROMO' then 1 else 0 end) as bulk_days
  from lineitem join part on l_partkey = p_partkey group by l_orderkey),
lens_b AS (
  select o_orderkey as order_id, o_custkey as customer_id, o_orderdate, last_ship, bulk_days,
         case when first_supplier % 10 = 0 then 6 else 0 end as slow_days,
         case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'canceled'
              when o_orderstatus = 'P' and o_orderpriority = '4-NOT SPECIFIED' and o_orderkey % 2 = 0 then 'unavailable'
              when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'shipped'
              else 'delivered' end as order_status,
         o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int) as order_purchase_timestamp
  from orders left join lens_sh on o_orderkey = l_orderkey),
raw_orders AS (
  select order_id, customer_id, order_status, order_purchase_timestamp,
         case when order_id % 500 = 7 then null
              else order_purchase_timestamp + interval '1' hour * cast(order_id % 37 as int) end as order_approved_at,
         cast(null as timestamp) as order_delivered_carrier_date,
         case when order_status <> 'delivered' or order_id % 1000 = 3 then null
              else order_purchase_timestamp + interval '1' day * cast(extract(doy from last_ship) % 45 + bulk_days + slow_days + case when order_id % 701 = 9 then 190 else 0 end as int)
                   + interval '1' hour * cast(order_id % 13 as int) end as order_delivered_customer_date,
         o_orderdate + interval '1' day * cast(42 + order_id % 4 * 2 as int) as order_estimated_delivery_date
  from lens_b),
raw_payments AS (
  select l_orderkey as order_id,
         case when l_returnflag = 'N' and l_linestatus = 'O' and l_quantity < 3 then 'not_defined'
              when l_returnflag = 'R' then 'credit_card' when l_returnflag = 'A' then 'boleto' else 'voucher' end as payment_type,
         cast(l_quantity as int) % 24 + 1 as payment_installments,
         cast(round(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as decimal(12,2)) as payment_value
  from lineitem),
raw_reviews AS (
  select case when event_id % 50 = 1 then event_id - 1 else event_id end as review_id,
         cast(floor(event_id / 2) as bigint) as order_id, cast(event_id % 5 + 1 as int) as review_score,
         cast(null as varchar) as review_comment_title,
         case when event_type = 'error' then null else event_type end as review_comment_message, ts as review_creation_date,
         cast(null as timestamp) as review_answer_timestamp
  from events),
lens_g AS (
  select c_nationkey as geolocation_zip_code_prefix,
         cast(cast(c_acctbal as decimal(12,2)) * 0.004 - 20 as double) as geolocation_lat,
         cast(-50 - cast(c_acctbal as decimal(12,2)) * 0.003 as double) as geolocation_lng,
         c_mktsegment as geolocation_city, n_name as geolocation_state, c_custkey
  from customer join nation on c_nationkey = n_nationkey),
raw_geolocation AS (
  select geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state from lens_g
  union all
  select geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state from lens_g
  where c_custkey % 4 = 0)
"""

_LAT, _LNG = P.box_lat, P.box_lng
_MANUAL = " ".join(f"when '{k}' then '{v}'" for k, v in P.manual_translations)
_US = "date_diff('microsecond', {a}, {b})"


def _floor_days(a: str, b: str) -> str:
    return f"cast(floor({_US.format(a=a, b=b)} / 86400000000.0) as bigint)"


STAR = f"""
dim_customers AS (select * from raw_customers),
dim_sellers AS (select * from raw_sellers),
fact_order_items AS (select * from raw_items),
pay_kept AS (select * from raw_payments where payment_type is distinct from '{P.not_defined_payment}'),
pay_type_rank AS (
  select order_id, payment_type,
         row_number() over (partition by order_id order by count(*) desc, payment_type asc) as rn
  from pay_kept where payment_type is not null group by order_id, payment_type),
bridge_payments AS (
  select k.order_id, cast(sum(payment_value) as decimal(12,2)) as payment_value,
         cast(max(payment_installments) as integer) as payment_installments,
         min(t.payment_type) as payment_type_primary,
         cast(count(distinct k.payment_type) as integer) as payment_type_count
  from pay_kept k left join pay_type_rank t on k.order_id = t.order_id and t.rn = 1
  group by k.order_id),
rev_ranked AS (
  select *, row_number() over (partition by review_id order by review_creation_date nulls first, order_id nulls first,
         review_score nulls first, review_comment_message nulls first, review_comment_title nulls first,
         review_answer_timestamp nulls first) as rn
  from raw_reviews),
bridge_reviews AS (
  select review_id, order_id, review_score, review_comment_title, review_comment_message, review_creation_date,
         review_answer_timestamp, review_comment_message is not null as has_comment
  from rev_ranked where rn = 1),
prod_named AS (
  select p.*, coalesce(t.product_category_name_english,
                       case p.product_category_name {_MANUAL} end, '{P.uncategorized}') as product_category_name_english
  from raw_products p left join raw_translation t on p.product_category_name = t.product_category_name),
prod_cat_median AS (
  select product_category_name_english as cat, median(product_weight_g) as w, median(product_length_cm) as l,
         median(product_height_cm) as h, median(product_width_cm) as wd
  from prod_named group by product_category_name_english),
dim_products AS (
  select product_id, product_category_name, product_category_name_english,
    cast(coalesce(product_weight_g, m.w, (select median(product_weight_g) from prod_named)) as decimal(10,2)) as product_weight_g,
    cast(coalesce(product_length_cm, m.l, (select median(product_length_cm) from prod_named)) as decimal(10,2)) as product_length_cm,
    cast(coalesce(product_height_cm, m.h, (select median(product_height_cm) from prod_named)) as decimal(10,2)) as product_height_cm,
    cast(coalesce(product_width_cm, m.wd, (select median(product_width_cm) from prod_named)) as decimal(10,2)) as product_width_cm
  from prod_named n left join prod_cat_median m on n.product_category_name_english = m.cat),
geo_box AS (
  select distinct * from raw_geolocation),
geo_kept AS (
  select * from geo_box
  where geolocation_lat between {_LAT[0]} and {_LAT[1]} and geolocation_lng between {_LNG[0]} and {_LNG[1]}),
geo_city AS (
  select geolocation_zip_code_prefix z, geolocation_city v,
         row_number() over (partition by geolocation_zip_code_prefix order by count(*) desc, geolocation_city) rn
  from geo_kept group by 1, 2),
geo_state AS (
  select geolocation_zip_code_prefix z, geolocation_state v,
         row_number() over (partition by geolocation_zip_code_prefix order by count(*) desc, geolocation_state) rn
  from geo_kept group by 1, 2),
dim_geolocation AS (
  select g.geolocation_zip_code_prefix as zip_code_prefix, round(median(geolocation_lat), 6) as geolocation_lat,
         round(median(geolocation_lng), 6) as geolocation_lng,
         min(c.v) as geolocation_city, min(s.v) as geolocation_state
  from geo_kept g left join geo_city c on c.z = g.geolocation_zip_code_prefix and c.rn = 1
       left join geo_state s on s.z = g.geolocation_zip_code_prefix and s.rn = 1
  group by g.geolocation_zip_code_prefix),
fo_base AS (
  select o.*,
    exists (select 1 from raw_items i where i.order_id = o.order_id) as has_items,
    exists (select 1 from bridge_payments b where b.order_id = o.order_id) as has_payment,
    coalesce(order_status = '{P.delivered_status}'
             and cast(order_delivered_customer_date as date) in ({dlist(P.placeholder_dates)}), false)
        as has_placeholder_delivery_date,
    {_floor_days('order_purchase_timestamp', 'order_delivered_customer_date')} as dtd,
    {_floor_days('order_estimated_delivery_date', 'order_delivered_customer_date')} as dve,
    {_US.format(a='order_purchase_timestamp', b='order_approved_at')} as lag_us
  from raw_orders o),
fact_orders AS (
  select order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
    order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
    has_items, has_payment, has_placeholder_delivery_date,
    cast(case when not has_placeholder_delivery_date and dtd >= 0 then dtd end as integer) as days_to_deliver,
    cast(case when not has_placeholder_delivery_date then dve end as integer) as days_vs_estimate,
    case when not has_placeholder_delivery_date then coalesce(dve > 0, false) end as is_late,
    cast({rr('lag_us', '3600000000', 2)} as decimal(12,2)) as approval_lag_hours
  from fo_base)
"""


def with_star(*ctes: str, select: str) -> str:
    """Full oracle statement: lens + star + the query's own CTEs + final select."""
    body = ",\n".join([LENS.strip(), STAR.strip(), *[c.strip() for c in ctes if c.strip()]])
    if select.lstrip().startswith(","):  # the query adds CTEs of its own
        return f"WITH {body}{select}"
    return f"WITH {body}\n{select}"
