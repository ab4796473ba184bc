"""Counting and comparing the length-k substrings of sequence reads, on Spark."""
