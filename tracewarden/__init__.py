"""Request-log security analytics as Spark jobs."""
