"""Column functions: hashing, cardinality sketches, packed registers."""
