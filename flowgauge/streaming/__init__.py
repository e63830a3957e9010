"""The three streaming queries."""
