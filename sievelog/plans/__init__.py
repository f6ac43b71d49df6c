"""Queries as trees, and the plans they become."""
