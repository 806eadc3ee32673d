"""Readers and writers of graph and mesh files, and graphs derived from tables."""
