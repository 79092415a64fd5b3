"""A Spark-first engine for descriptor classification, evaluation and corpus preparation."""
