"""Trip-flow analytics as Spark DataFrame jobs."""
