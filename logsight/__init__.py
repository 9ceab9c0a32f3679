"""Analytics over logs and security events, on Spark DataFrames and streams."""
