"""Column helpers: missing-value rules and clock arithmetic."""
