"""Operators on streams of pixel rows."""
