"""Column expressions, signal generators, SQL registration."""
