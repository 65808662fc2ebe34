"""Graph operators: each takes and returns DataFrames (no driver collect)."""
