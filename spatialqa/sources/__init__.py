"""Readers, writers and input checks."""
