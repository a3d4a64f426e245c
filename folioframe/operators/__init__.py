"""Relational operators over document, profile and career tables."""
