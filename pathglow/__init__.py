"""Analytics over activity-heat tiles, map geometry and human reviews, on Spark DataFrames."""
