"""Support-desk analytics as Spark DataFrame jobs."""
