"""Log template and alarm analytics on PySpark."""
