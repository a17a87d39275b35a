"""Readers and writers of palettes, sheets, sequences and the tables that queries start from."""
