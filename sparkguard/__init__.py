"""Schema-change safety, data-integrity checks and corpus operators as Spark jobs."""
