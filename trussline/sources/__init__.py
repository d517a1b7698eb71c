"""Readers of packages and source files."""
