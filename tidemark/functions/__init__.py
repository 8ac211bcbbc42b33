"""Column expressions and order helpers shared by the operators."""
