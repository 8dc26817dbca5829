"""Analytics, verification, metrics, rating and text functions over DataFrames."""
