"""Schemas, readers and writers, generators, views of other tables."""
