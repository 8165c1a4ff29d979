"""Column expressions and the session/scratch helpers used by the operators."""
