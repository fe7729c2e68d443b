"""Log and event analytics on PySpark."""
