"""sources of barlattice."""
