"""Parsing expressions over several sets into plans."""
