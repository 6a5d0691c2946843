"""End-to-end jobs: from files to feature tables, models and forecasts."""
