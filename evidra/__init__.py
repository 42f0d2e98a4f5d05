"""Evidence retrieval, deterministic calculation and corpus preparation on Spark."""
