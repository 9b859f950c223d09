"""Operators of a training-data pipeline: one module an operator, and their queries."""
