"""Column-building functions: growth curves, normal quantiles, repeatable noise."""
