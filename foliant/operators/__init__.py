"""Relational jobs over the library tables."""
