"""Readers and writers of library tables and logs."""
