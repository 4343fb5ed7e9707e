"""DataFrame operators: features, exact quantiles, scoring, transforms,
clustering, profiles and cohorts."""
