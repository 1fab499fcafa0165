"""Column expressions and small helpers that the operators share."""
