"""Track analytics over position reports, written as Spark jobs."""
