"""Relational operators over references, claims, registry records and verdicts."""
