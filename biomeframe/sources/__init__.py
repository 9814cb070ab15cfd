"""Readers, writers and the abundance views of the test tables."""
