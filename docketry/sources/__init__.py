"""Readers and writers of the corpus's files, with explicit schemas."""
