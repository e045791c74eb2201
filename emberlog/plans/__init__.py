"""Manifest and compaction: what a store's files are and how they change."""
