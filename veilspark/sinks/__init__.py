"""Masked and restored files."""
