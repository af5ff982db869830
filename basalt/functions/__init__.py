"""Column expressions that several operators share; all run inside Spark's own engine."""
