"""Column expressions. All are built-in Catalyst expressions."""
