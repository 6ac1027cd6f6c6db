"""Column expressions and driver-side statistics."""
