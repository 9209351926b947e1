"""Book-catalogue and reader analytics as Spark DataFrame jobs."""
