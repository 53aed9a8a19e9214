"""Analytics over portfolios of building floor plans, as Spark DataFrame, SQL and Structured Streaming jobs."""
