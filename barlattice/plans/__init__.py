"""plans of barlattice."""
