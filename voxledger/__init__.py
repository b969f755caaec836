"""Customer-feedback analytics on Spark."""
