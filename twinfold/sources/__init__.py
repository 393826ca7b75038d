"""Readers and writers: tab text, any DataFrame, the TPC-H-style test tables."""
