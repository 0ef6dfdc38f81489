"""reviewmill: customer-review analytics as Spark DataFrame jobs."""
