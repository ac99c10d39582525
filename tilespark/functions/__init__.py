"""Column functions: projection, tile addresses, geometry and command integers."""
