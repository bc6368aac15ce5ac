"""Graph operators: handle and access, paths, clustering, cuts, components."""
