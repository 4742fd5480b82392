"""End-to-end compositions and the domain views over the sample tables."""
