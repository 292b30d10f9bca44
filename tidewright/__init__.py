"""tidewright: ordered time-series analytics on PySpark."""
