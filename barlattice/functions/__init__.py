"""functions of barlattice."""
