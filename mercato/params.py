"""Run parameters.

Every constant the analytics depend on lives here, so the same jobs run on the
production star and on the test fixtures (which only differ in dates).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # --- fixed values of the business rules (must equal the published rules) ---
    # RFM reference date: the day after the last order of the data set.
    rfm_reference_date: dt.date = dt.date(2018, 10, 17)
    # Cohort window: first full cohort .. last cohort with follow-up data.
    cohort_start: dt.date = dt.date(2016, 10, 1)
    cohort_end: dt.date = dt.date(2018, 8, 1)
    # Singleton cohort that consumers of the cohort view drop.
    cohort_exclude: tuple[dt.date, ...] = (dt.date(2016, 12, 1),)
    # Delivery dates that are placeholders (only for delivered orders).
    placeholder_dates: tuple[dt.date, ...] = (dt.date(2017, 9, 19), dt.date(2018, 9, 19))
    # Geolocation bounding box (Brazil), as cleaned: lat -33.75..5.27, lng -73.99..-28.85.
    box_lat: tuple[float, float] = (-33.75, 5.27)
    box_lng: tuple[float, float] = (-73.99, -28.85)
    # Box used by the profiling report: lat -33.7..5.3, lng -73.9..-28.8.
    profile_box_lat: tuple[float, float] = (-33.7, 5.3)
    profile_box_lng: tuple[float, float] = (-73.9, -28.8)
    # Delivery-time sanity bound (days) of the cleaning report.
    max_delivery_days: int = 180
    # Minimum group sizes.
    sla_min_orders: int = 30
    seller_min_orders: int = 10
    cancel_min_orders_month: int = 50
    cancel_min_orders_state: int = 50
    cancel_min_orders_category: int = 30
    revenue_vs_late_min_orders: int = 100
    # SLA tier cut-offs (late rate in percent, compared after rounding).
    sla_critical: float = 10.0
    sla_below_average: float = 6.7
    sla_average: float = 3.0
    # Seller risk tiers: (late rate pct, min orders).
    seller_high_risk: tuple[float, int] = (20.0, 50)
    seller_elevated_risk: tuple[float, int] = (10.0, 20)
    seller_strong: tuple[float, int] = (6.7, 50)
    # Statuses.
    delivered_status: str = "delivered"
    cancel_statuses: tuple[str, ...] = ("canceled", "unavailable")
    cancel_statuses_narrow: tuple[str, ...] = ("canceled",)
    not_defined_payment: str = "not_defined"
    # fixed values: manual English names for categories missing from the translation table
    manual_translations: tuple[tuple[str, str], ...] = (
        ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_food_prep"),
        ("pc_gamer", "gaming_pc"),
        ("fashion_roupa_infanto_juvenil", "fashion_kids_clothing"),
    )
    uncategorized: str = "uncategorized"
    ml_unknown_category: str = "unknown"
    # First operational month(s), left out of the monthly cancellation chart.
    cancel_exclude_months: tuple[dt.date, ...] = (dt.date(2016, 10, 1),)
    # Window of the operational monthly cancellation trend.
    ops_cancel_start: dt.date = dt.date(2017, 1, 1)
    ops_cancel_end: dt.date = dt.date(2018, 8, 1)
    # fixed values: published figures of the final EDA check, (metric, value, tolerance)
    expected_figures: tuple[tuple[str, float, float], ...] = (
        ("rfm_customers", 93470, 0), ("rfm_revenue", 15422462, 0.5), ("cohorts", 21, 0),
        ("max_retention_pct_after_period0", 0.71, 0.005), ("revenue_months", 23, 0), ("peak_month_revenue", 1137527, 0.5),
        ("total_revenue", 15222078, 1), ("critical_categories", 6, 0), ("worst_category_late_rate_pct", 13.51, 0.005),
        ("categories_min_orders_scatter", 51, 0), ("sellers_min_orders", 1238, 0), ("max_monthly_cancel_rate_pct", 3.48, 0.005),
        ("worst_state_cancel_rate_pct", 2.77, 0.005), ("seller_rate_late", 11.62, 0.01), ("seller_rate_ontime", 6.21, 0.01),
        ("approval_lag_late", 8.63, 0.01), ("approval_lag_ontime", 8.37, 0.01), ("feature_rows", 96178, 0), ("feature_nulls", 0, 0),
    )
    # Dashboard click action: restrict segment-driven sheets to one RFM segment.
    segment_filter: str | None = None
    # Sample / correlation / ML settings.
    sample_size: int = 5000
    sample_max_lag_hours: float = 72.0
    sample_seed: int = 42
    corr_threshold: float = 0.70
    seed: int = 42
    test_fraction: float = 0.2
    threshold: float = 0.5
    # Threshold of the evaluation of the seller's late rate as a score.
    rate_threshold: float = 0.10
    cold_start_orders: int = 10
    num_trees: int = 300
    # Split statistics of one pass over the rows.  Every running task holds as much, so an executor needs it once a core.
    forest_node_memory_mb: int = 64
    # Trees that one fit grows: every running task holds a copy of them.
    forest_trees_at_once: int = 30
    # Split candidates per feature; at least the number of categories, whose codes are numbers.
    forest_max_bins: int = 256
    # Temporal split / drift: orders before the cutoff are the earlier period.
    temporal_cutoff: dt.date = dt.date(2018, 4, 1)
    drift_edges: tuple[float, ...] = (5.0, 10.0, 15.0, 20.0, 30.0, 50.0)
    risk_top_k: int = 10

    def cohort_periods(self) -> int:
        """Months from the first cohort to the reference date, both included."""
        a, b = self.cohort_start, self.rfm_reference_date
        return (b.year - a.year) * 12 + b.month - a.month + 1

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# Reference constants re-based onto the driver's synthetic tables (FIXTURES.md).
FIXTURE_PARAMS = Params(
    rfm_reference_date=dt.date(2001, 8, 2),
    cohort_start=dt.date(1995, 2, 1),
    cohort_end=dt.date(2001, 7, 1),
    cohort_exclude=(dt.date(1995, 3, 1),),
    placeholder_dates=(dt.date(1997, 9, 19), dt.date(1998, 9, 19)),
    cancel_exclude_months=(dt.date(1995, 1, 1),),
    ops_cancel_start=dt.date(1996, 1, 1),
    ops_cancel_end=dt.date(2001, 7, 1),
    temporal_cutoff=dt.date(2000, 6, 1),
    expected_figures=(("cohorts", 66, 12), ("feature_nulls", 0, 0), ("critical_categories", -1, 0)),
)
