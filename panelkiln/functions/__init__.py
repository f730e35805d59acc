"""Column expressions that carry the null, tie and rounding rules of panel work."""
