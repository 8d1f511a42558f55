"""Readers and writers that produce and consume node tables."""
