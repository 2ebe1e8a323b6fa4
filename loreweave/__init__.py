"""Knowledge indexing, retrieval and data preparation on Spark."""
