"""Scalar functions as column expressions, and the fixed values they need."""
