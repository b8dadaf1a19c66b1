"""Readers, writers and renderers."""
