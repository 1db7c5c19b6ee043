"""Whole plans a user calls: reports, display forms, loads, the fact and rollup."""
