"""Readers of character-data files, and table sinks."""
