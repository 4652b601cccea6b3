"""Per-entity time-series and response-curve features on Spark DataFrames."""
