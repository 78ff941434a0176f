"""Readers and writers that keep the order of rows."""
