"""tallyspark: evidence-first financial analytics as Spark jobs."""
