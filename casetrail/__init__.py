"""Process analytics on event logs with PySpark."""
