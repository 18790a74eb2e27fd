"""Relational operators over stops, production and calendar tables."""
