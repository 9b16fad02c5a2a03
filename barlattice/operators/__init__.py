"""operators of barlattice."""
