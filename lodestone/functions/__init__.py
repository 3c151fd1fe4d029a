"""Scalar types and functions on their values."""
