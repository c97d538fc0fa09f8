"""Spark jobs for large document archives."""
