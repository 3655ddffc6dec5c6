"""Readers and writers: tables, JSON lines, and the fixture log over the sample tables."""
