"""Readers, writers and the staging area between pipeline steps."""
