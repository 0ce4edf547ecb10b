"""Operators on hypergraph frames."""
