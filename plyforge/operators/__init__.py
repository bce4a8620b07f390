"""Relational operators over position datasets."""
