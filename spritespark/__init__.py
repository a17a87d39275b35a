"""Spark jobs over large collections of sprites, animations and pixel images."""
