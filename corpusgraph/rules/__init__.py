"""Fixed word lists, weights, patterns and label tables, kept apart from the operators."""
