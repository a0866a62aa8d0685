"""Operators for training data: one module per operator, `catalog` holds their queries."""
