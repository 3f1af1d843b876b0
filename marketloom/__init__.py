"""marketloom: retail analytics as Spark DataFrame jobs."""
