"""Readers and parsers of feeds and semi-structured JSON."""
