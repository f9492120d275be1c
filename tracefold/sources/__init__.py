"""Readers, writers and the response cache."""
