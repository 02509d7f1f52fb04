"""Readers, writers and keyed caches."""
