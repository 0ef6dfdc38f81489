"""Readers, writers and the fingerprinted index table."""
