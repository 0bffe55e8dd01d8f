"""Resumable and incremental collection."""
