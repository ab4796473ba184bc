"""Operators on reads and on sets of k-mers."""
