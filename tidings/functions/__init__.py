"""Columns in, columns out: text, dates and replies."""
