"""Column expressions: text folding, coercion, labels and ordered rules."""
