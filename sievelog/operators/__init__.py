"""Operators on lines, blocks and postings."""
