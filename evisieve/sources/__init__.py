"""Readers and caches of documents."""
