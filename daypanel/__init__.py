"""Panel time series on Spark: region-by-day counts to metrics, rankings, trends, projections and report tables."""
