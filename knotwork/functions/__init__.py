"""Column and table functions that several operators use."""
