"""Column functions: text, glyphs, geometry, and their fixed values."""
