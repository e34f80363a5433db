"""Column expressions for coordinates, geometry and text."""
