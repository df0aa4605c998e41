"""Unit tests on hand-made rows for the decided semantics."""

import datetime as dt

from pyspark.sql import functions as F

from mercato.functions.numeric import round_ratio
from mercato.functions.timefx import floor_days, months_between_starts, pg_dow
from mercato.params import FIXTURE_PARAMS as P
from mercato.plans import clean
from mercato.plans import views as V


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_floor_days_half_day_early_is_minus_one(spark):  # T7
    df = spark.createDataFrame([(ts("2020-01-02 12:00:00"), ts("2020-01-02 00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(floor_days("a", "b")).first()[0] == -1
    assert df.select(F.datediff(F.to_date("b"), F.to_date("a"))).first()[0] == 0


def test_pg_day_of_week_sunday_is_zero(spark):  # T11
    df = spark.createDataFrame([(ts("2020-01-05 10:00:00"),)], "t timestamp_ntz")  # a Sunday
    assert df.select(pg_dow("t")).first()[0] == 0


def test_months_between_starts(spark):  # F7
    df = spark.createDataFrame([(dt.date(2017, 11, 1), dt.date(2018, 2, 1))], "a date, b date")
    assert df.select(months_between_starts("b", "a")).first()[0] == 3


def test_round_ratio_ties_half_away_from_zero(spark):  # T22
    df = spark.createDataFrame([(1, 8), (-1, 8), (2003, 200), (1, 0)], "n long, d long")
    got = [r[0] for r in df.select(round_ratio("n", "d", 2)).collect()]
    assert got == [0.13, -0.13, 10.02, None]  # 0.125 -> 0.13, 10.015 -> 10.02, /0 -> NULL


def _orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, customer_id long, order_status string, "
                                       "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
                                       "order_delivered_carrier_date timestamp_ntz, "
                                       "order_delivered_customer_date timestamp_ntz, "
                                       "order_estimated_delivery_date timestamp_ntz")


def test_fact_orders_late_flag_and_placeholders(spark):  # T6, T8, Q7
    o = _orders(spark, [
        (1, 1, "delivered", ts("1997-01-01 10:00:00"), None, None, ts("1997-01-20 09:00:00"), ts("1997-01-10 00:00:00")),
        (2, 1, "shipped", ts("1997-01-01 10:00:00"), None, None, None, ts("1997-01-10 00:00:00")),
        (3, 1, "delivered", ts("1997-09-01 10:00:00"), None, None, ts("1997-09-19 09:00:00"), ts("1997-10-10 00:00:00")),
        (4, 1, "delivered", ts("1997-01-05 10:00:00"), None, None, ts("1997-01-04 09:00:00"), ts("1997-01-10 00:00:00")),
        (5, 1, "delivered", ts("1997-01-01 10:00:00"), None, None, ts("1997-08-01 09:00:00"), ts("1997-01-10 00:00:00")),
    ])
    items = spark.createDataFrame([(1,), (3,)], "order_id long")
    pay = spark.createDataFrame([(1,)], "order_id long")
    fo = {r.order_id: r for r in clean.fact_orders(o, items, pay, P).collect()}
    assert fo[1].is_late is True and fo[1].days_vs_estimate == 10 and fo[1].days_to_deliver == 18
    assert fo[2].is_late is False  # missing delivery compares to False, not NULL
    assert fo[3].has_placeholder_delivery_date and fo[3].is_late is None and fo[3].days_to_deliver is None
    assert fo[4].days_to_deliver is None and fo[4].days_vs_estimate == -6  # negative delivery nulled
    assert fo[5].days_to_deliver == 211 and fo[5].is_late is True  # > 180 days is listed, not removed
    assert fo[1].has_items and not fo[2].has_items and fo[1].has_payment and not fo[3].has_payment


def test_payment_mode_lowest_on_ties(spark):  # T14, T15
    pay = spark.createDataFrame([(1, "voucher", 1, 5.0), (1, "boleto", 2, 5.0), (1, "not_defined", 9, 1.0),
                                 (2, "not_defined", 1, 3.0)],
                                "order_id long, payment_type string, payment_installments int, payment_value double")
    pay = pay.withColumn("payment_value", F.col("payment_value").cast("decimal(12,2)"))
    got = {r.order_id: r for r in clean.payments_by_order(pay, P).collect()}
    assert got[1].payment_type_primary == "boleto" and got[1].payment_type_count == 2
    assert got[1].payment_installments == 2 and float(got[1].payment_value) == 10.0
    assert 2 not in got  # only not_defined -> no payment row -> has_payment false


def test_review_dedup_keeps_earliest(spark):  # T16
    r = spark.createDataFrame([
        (1, 11, 5, None, "b", ts("2020-01-02 00:00:00"), None),
        (1, 10, 1, None, None, ts("2020-01-01 00:00:00"), None),
        (2, 12, 3, None, "x", ts("2020-01-01 00:00:00"), None)],
        "review_id long, order_id long, review_score int, review_comment_title string, "
        "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz")
    got = {x.review_id: x for x in clean.clean_reviews(r).collect()}
    assert got[1].order_id == 10 and got[1].has_comment is False and got[2].has_comment is True


def test_sla_tier_uses_rounded_rate(spark):  # T20, golden tier ladder
    rows = [(9.995,), (6.695,), (2.999,), (10.0,)]
    df = spark.createDataFrame(rows, "r double").select(F.round("r", 2).alias("r"))
    tiers = [x[0] for x in df.select(V.sla_tier(F.col("r"), P)).collect()]
    assert tiers == ["Critical", "Below Average", "Average", "Critical"]


def test_rfm_segment_ladder(spark):
    df = spark.createDataFrame([(3, 3, 3), (3, 2, 1), (3, 1, 4), (2, 3, 1), (1, 4, 1), (2, 2, 1), (1, 2, 1),
                                (1, 1, 1)], "r int, f int, m int")
    got = [x[0] for x in df.select(V.rfm_segment(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert got == ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Cannot Lose Them", "Needs Attention",
                   "Hibernating", "Lost"]


def test_golden_category_sla_rates_and_tiers(spark):
    """Published (total_orders, late_orders) -> (late_rate_pct, tier) pairs of the
    shipped SLA extract, typed in: rate = round(late / orders * 100, 2), tier from
    the rounded rate."""
    golden = [  # fixed values: rows of the published category SLA extract
        (37, 5, 13.51, "Critical"), (124, 15, 12.1, "Critical"), (348, 42, 12.07, "Critical"),
        (1251, 131, 10.47, "Critical"), (117, 12, 10.26, "Critical"), (390, 39, 10.0, "Critical"),
        (242, 22, 9.09, "Below Average"), (6288, 565, 8.99, "Below Average"), (413, 35, 8.47, "Below Average"),
        (36, 3, 8.33, "Below Average"), (9242, 765, 8.28, "Below Average"),
    ]
    from mercato.params import Params

    df = spark.createDataFrame([g[:2] for g in golden], "n long, late long")
    rate = round_ratio(F.col("late") * 100, "n", 2)
    got = df.select(rate.alias("r"), V.sla_tier(rate, Params()).alias("t")).collect()
    assert [(r.r, r.t) for r in got] == [(g[2], g[3]) for g in golden]
