"""Column functions: cleaning, labels, rules, field extraction."""
