"""Feature lists, thresholds and fixed vocabularies.

Everything in the block below is a fixed value: downstream results depend on the
exact spelling, order and number, so they are stated once, here, in plain form.
"""

# --- fixed values -----------------------------------------------------------

# Feature vectors; the order is the model's input contract.
CLUSTERING_FEATURES = [
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "premium_trip_ratio",
    "quest_completion_rate",
    "cancellation_rate",
]
CHURN_NUMERIC_FEATURES = CLUSTERING_FEATURES + ["acceptance_rate", "pro_tier_rank"]
CHURN_FEATURES = CHURN_NUMERIC_FEATURES + ["cluster_label"]

FEATURE_COLUMNS = [
    "driver_id",
    "signup_date",
    "avg_rating",
    "current_tier",
    "Churned",
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "is_premium_capable",
    "premium_trip_ratio",
    "peak_hour_driver_score",
    "session_regularity",
    "quest_completion_rate",
    "incentive_reliance_pct",
    "pro_tier_rank",
    "cancellation_rate",
    "acceptance_rate",
    "session_count",
]

COHORT_COLUMNS = [
    "driver_id",
    "signup_date",
    "avg_rating",
    "is_premium_capable",
    "pro_tier_rank",
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "premium_trip_ratio",
    "quest_completion_rate",
    "cancellation_rate",
    "acceptance_rate",
    "peak_hour_driver_score",
    "session_regularity",
    "session_count",
    "incentive_reliance_pct",
    "week",
]

# Columns whose history statistics calibrate a synthetic cohort.
CALIBRATED_FEATURES = [
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "premium_trip_ratio",
    "quest_completion_rate",
    "cancellation_rate",
    "acceptance_rate",
    "peak_hour_driver_score",
    "session_regularity",
    "incentive_reliance_pct",
    "avg_rating",
]

CORRELATION_FEATURES = [
    "avg_earnings_per_hour_online",
    "trip_utilization_rate",
    "surge_reliance_score",
    "acceptance_rate",
    "cancellation_rate",
    "premium_trip_ratio",
    "quest_completion_rate",
]

FINGERPRINT_METRICS = {
    "acceptance_rate": "Acceptance Rate",
    "trip_utilization_rate": "Trip Utilization",
    "surge_reliance_score": "Surge Reliance",
    "quest_completion_rate": "Quest Completion",
    "cancellation_rate": "Cancellation Rate",
    "avg_earnings_per_hour_online": "Avg Earnings/Hr",
}

# Vocabularies of the raw logs.
TIERS = ["Blue", "Gold", "Platinum", "Diamond"]
TRIP_TYPES = ["UberX", "Comfort", "Electric", "Premier", "UberBlack"]
PREMIUM_TRIP_TYPES = ["UberBlack", "Premier"]
EVENT_TYPES = [
    "app_open",
    "destination_set",
    "heatmap_view",
    "trip_accepted",
    "trip_cancelled",
    "trip_ignored",
]

# Tier rank -> name and lifetime-trip threshold.
TIER_NAMES = {1: "Blue", 2: "Gold", 3: "Platinum", 4: "Diamond"}
TIER_THRESHOLDS = {1: 0, 2: 100, 3: 250, 4: 500}

# Personas.
CASUAL = "Casual / At-Risk"
QUEST = "Quest Grinder"
PREMIUM = "Premium Specialist"
PRO = "Pro-Optimizer"
PERSONAS = [CASUAL, QUEST, PREMIUM, PRO]
PREMIUM_RATIO_ABOVE = 0.35
QUEST_RATE_ABOVE = 0.50
PRO_UTILIZATION_ABOVE = 0.40
CLUSTER_COUNT = 4
CLUSTER_STARTS = 10

MATURITY_PERSONAS = {
    CASUAL: "Casual (The Rookie)",
    PRO: "Pro-Optimizer (The Strategist)",
    QUEST: "Quest Grinder (The Hustler)",
}
MATURITY_METRICS = {
    "trip_utilization_rate": "Asset Utilization",
    "surge_reliance_score": "Market Intelligence",
    "quest_completion_rate": "Goal Achievement",
    "avg_earnings_per_hour_online": "Earnings Efficiency (normalized)",
}
EARNINGS_COMPONENTS = {
    "pct_organic": "Organic (Fare + Tip)",
    "pct_incentive": "Inorganic (Quest Bonuses)",
}
EARNINGS_PERSONAS = [QUEST, PRO]

# Campaign.
HIGH_RISK_FROM = 0.5
NUDGE_SHARE = 0.5
LOW_EARNINGS_BELOW = 15.0
HIGH_CANCEL_ABOVE = 0.15
MISSING_EARNINGS = 99.0
MISSING_CANCEL = 0.0
FALLBACK_BENCHMARKS = {"pro_epho_median": 28.0, "pro_util_median": 55.0, "pro_cancel_median": 3.0}
RISK_BANDS = (0.35, 0.55)
TOP_RISK_ROWS = 10

# Synthetic cohort.
COHORT_SIZE = 30
COHORT_TIER_WEIGHTS = {1: 0.45, 2: 0.30, 3: 0.15, 4: 0.10}

# Churn model search space.
SEARCH_SPACE = {
    "n_estimators": [100, 200, 300, 400, 500],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
    "max_depth": [3, 4, 5, 6],
    "gamma": [0.0, 0.1, 0.5, 1.0],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
    "reg_lambda": [0.1, 1.0, 5.0, 10.0],
}
SEARCH_DRAWS = 50
SEARCH_FOLDS = 5
TEST_SHARE = 0.2
SEED = 42

# --- end of fixed values ----------------------------------------------------

LOCAL_ZONE = "America/New_York"
