"""Column expressions: text features, prices, vectors, personal-data patterns."""
