"""Helpers that shape plans: shared storage, cut lineage, graph components."""
