"""Column expressions and the values they agree with."""
