"""Panel, evidence and text analytics as Spark DataFrame jobs."""
