"""Readers and writers for feeds, tables and label files."""
