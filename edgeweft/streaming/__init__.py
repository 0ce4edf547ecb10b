"""Hyperedges that arrive over time."""
