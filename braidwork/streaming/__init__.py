"""Incremental counting."""
