"""Column expressions without a Python worker."""
