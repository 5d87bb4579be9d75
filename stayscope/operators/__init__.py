"""DataFrame -> DataFrame operators: profile, clean, features, market, eda, dashboard, ml, score."""
