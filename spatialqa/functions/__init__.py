"""Column builders: every function here returns a Catalyst expression, no Python runs per row."""
