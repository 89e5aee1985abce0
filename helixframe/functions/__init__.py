"""Column expressions of the token layer and the fixed tables."""
