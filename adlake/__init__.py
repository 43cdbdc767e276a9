"""adlake: job-market analytics as Spark DataFrame jobs."""
