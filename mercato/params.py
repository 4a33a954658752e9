"""Fixed values and parameter sets.

The business constants below must equal the reference's for the results to
match; they are stated plainly here, in one place, as fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's)
# ---------------------------------------------------------------------------
GROSS_MARGIN_PCT = 0.53
RETURN_HANDLING_COST_EUR = 18.0
MARKDOWN_DISCOUNT_PCT = 0.40
UNSOLD_DESTRUCTION_RATE = 0.15
PRICE_TO_EUR = 800.0
SAFETY_FACTOR = 1.2
NAIVE_NOISE_STD = 0.25
REALLOC_CAP = 2.5
REALLOC_ROUNDS = 5
REALLOC_SCORE_FLOOR = 0.01
ALPHA_OPTIMAL = 0.1
# α grid: 11 evenly spaced points on [0, 1], computed as k * 0.1 (k < 10) and 1.0,
# the same doubles an evenly spaced grid of 11 points gives.
ALPHA_GRID = [k * 0.1 for k in range(10)] + [1.0]
RANDOM_SEED = 42
DEFAULT_RETURN_RATE = 0.18
PRICE_FACTOR_HIGH = 1.15
PRICE_FACTOR_LOW = 0.95
ENGAGED_FACTOR = 0.85
NOT_ENGAGED_FACTOR = 1.05
ENGAGED_STATUSES = ["Regularly", "Monthly"]
RETURN_PROB_MIN = 0.01
RETURN_PROB_MAX = 0.95
RETURN_PROB_NOISE_STD = 0.05
LAGS = [1, 2, 4]
ROLLING_WINDOWS = [4, 8]
MIN_WEEKS_OVERALL = 8
COLD_START_MIN_WEEKS = 4
HOLDOUT_WEEKS = 8
ARTICLE_ID_WIDTH = 10
TRAIN_END = "2020-06-22"
VAL_END = "2020-08-22"
TEST_END = "2020-09-22"

# Fill labels and scenario names.
UNKNOWN_CATEGORY = "Unknown"      # missing categories in the returns features
MISSING_CATEGORY = "missing"      # missing categories in the demand preprocessing
NO_MODE = "N/A"                   # profile column when a group has no value
SCENARIO_NAMES = {
    "prod_oracle": "Oracle (perfect info)",
    "prod_naive": "Naive baseline",
    "prod_forecast": "Forecast-only (ML)",
    "prod_optimized": f"Optimized (smart, α={ALPHA_OPTIMAL})",
}

# Return rate by product group (the reference's table of garment-group rates).
RETURN_RATES_BY_GROUP = {
    "Garment Full body": 0.35,
    "Garment Lower body": 0.30,
    "Garment Upper body": 0.22,
    "Shoes": 0.25,
    "Accessories": 0.05,
    "Underwear": 0.10,
    "Socks & Tights": 0.05,
    "Nightwear": 0.10,
    "Swimwear": 0.20,
    "Bags": 0.08,
}

# Risk tiers of the reporting pages.
TIER_BOUNDS = (0.15, 0.30)          # low < .15 <= mid < .30 <= high
CATEGORY_TIER_BOUNDS = (0.15, 0.25)  # category colour tiers
HIGH_RISK_KPI = 0.30                 # KPI "high risk" is strictly greater

# The nine article attributes carried by the feature store.
ARTICLE_ATTRS = [
    "product_type_name", "product_group_name", "graphical_appearance_name",
    "colour_group_name", "perceived_colour_master_name", "department_name",
    "index_group_name", "section_name", "garment_group_name",
]
# The six categorical model features.
CATEGORY_COLS = [
    "product_group_name", "product_type_name", "colour_group_name",
    "department_name", "index_group_name", "garment_group_name",
]
RETURN_CAT_FEATURES = CATEGORY_COLS + ["club_member_status", "fashion_news_frequency"]

# ---------------------------------------------------------------------------
# Stand-in parameters for the driver's TPC-H-like tables (see FIXTURES.md §3)
# ---------------------------------------------------------------------------
STANDIN_RETURN_RATES = {
    "STANDARD": 0.35,
    "ECONOMY": 0.30,
    "MEDIUM": 0.22,
    "PROMO": 0.05,
    "SMALL": 0.10,
}
STANDIN_TRAIN_END = "2000-06-17"
STANDIN_VAL_END = "2001-02-24"
STANDIN_TEST_END = "2001-11-04"
STANDIN_COLD_START_WEEKS = 20
STANDIN_PRICE_DIVISOR = 2e6


@dataclass(frozen=True)
class EconParams:
    """Economic parameters of the per-article P&L."""
    gross_margin: float = GROSS_MARGIN_PCT
    return_cost: float = RETURN_HANDLING_COST_EUR
    markdown: float = MARKDOWN_DISCOUNT_PCT
    destruction: float = UNSOLD_DESTRUCTION_RATE


@dataclass(frozen=True)
class SplitDates:
    train_end: str = STANDIN_TRAIN_END
    val_end: str = STANDIN_VAL_END
    test_end: str | None = None


@dataclass(frozen=True)
class ReturnLabelParams:
    rates: dict = field(default_factory=lambda: dict(STANDIN_RETURN_RATES))
    default_rate: float = DEFAULT_RETURN_RATE
    noise_std: float = RETURN_PROB_NOISE_STD
    seed: int = RANDOM_SEED
