"""Pure functions and column expressions."""
