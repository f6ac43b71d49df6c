"""Streams of lines into a store."""
