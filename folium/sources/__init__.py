"""Snapshot discovery, readers and writers."""
