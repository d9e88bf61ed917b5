"""Column functions: text and token work, vector arithmetic, rule predicates."""
