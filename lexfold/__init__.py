"""Document-review analytics and training-data preparation on Spark."""
