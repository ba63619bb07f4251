"""Policy-governed queries and corpus preparation on Apache Spark."""
