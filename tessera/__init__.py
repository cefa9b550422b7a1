"""A Spark-first engine for structuring, mining and archiving text logs."""
