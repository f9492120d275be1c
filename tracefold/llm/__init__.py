"""Operators on training text: duplicates, entity and name matching, tokens, packing, personal information."""
