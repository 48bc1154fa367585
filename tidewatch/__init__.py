"""Comment-integrity analytics and training-data preparation on Spark."""
