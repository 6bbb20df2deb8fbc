"""Column expressions: severity levels, path rules, text rules, labels."""
