"""DataFrame operators: cleaning, quantiles, profiling, splits, features, metrics."""
