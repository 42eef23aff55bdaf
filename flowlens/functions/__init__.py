"""Column expressions: pure ``Column -> Column`` helpers, no jobs, no state."""
