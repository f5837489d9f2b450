"""The jobs: features, quality, profiling, segments, churn, campaign, reports."""
