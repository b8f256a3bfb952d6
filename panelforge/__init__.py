"""Panel, time-series and event analytics as Spark DataFrame operations."""
