"""Column expressions: tolerant casts, time buckets, filters, labels, formats."""
