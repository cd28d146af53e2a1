"""Column expressions: labels, text, addresses, request features, metrics."""
