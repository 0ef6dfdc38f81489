"""Column expressions: no job, no shuffle, usable in batch and streaming frames."""
