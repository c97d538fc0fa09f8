"""Scalar text, key and date functions as Column expressions."""
