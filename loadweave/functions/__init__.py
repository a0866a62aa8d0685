"""Column-level building blocks: every function here returns Spark columns."""
