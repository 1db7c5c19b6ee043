"""Readers: delimited text, stored tables, and the sample tables' mapping."""
