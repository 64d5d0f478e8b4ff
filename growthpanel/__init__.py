"""Growth-curve forecasting over panels of cumulative-count series, as Spark jobs."""
