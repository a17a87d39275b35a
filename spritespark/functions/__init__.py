"""Column functions of pixel and colour arithmetic."""
