"""Readers, writers and saved artifacts."""
