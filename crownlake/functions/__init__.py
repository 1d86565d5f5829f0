"""Column expressions and join helpers that the operators share."""
