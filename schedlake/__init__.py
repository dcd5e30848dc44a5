"""Schedule extraction and calendar maintenance as Spark jobs."""
