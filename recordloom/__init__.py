"""Evidence-first record analytics as plain Spark jobs."""
