"""DataFrame transformations from chunks to findings."""
