"""Scalar, array and map expressions."""
