"""Column functions: text, geometry, roles, names and states."""
