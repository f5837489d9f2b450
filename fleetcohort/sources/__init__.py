"""Schemas, readers, writers and the staging area."""
