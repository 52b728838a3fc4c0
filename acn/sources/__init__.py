"""Readers, sinks, schemas and fixed tables."""
