"""Spark jobs for triaging, labelling and digesting large tables of articles."""
