"""Readers and writers of manifests, parts, indexes and statistics."""
