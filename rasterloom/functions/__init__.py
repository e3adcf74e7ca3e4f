"""Column expressions: they add no job, no shuffle and no Python worker of their own."""
