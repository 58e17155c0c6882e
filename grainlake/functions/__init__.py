"""Column functions: boxes, lattices, vectors."""
