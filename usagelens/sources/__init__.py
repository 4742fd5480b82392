"""Readers, writers and row checks for usage logs, prompt caches and requests."""
