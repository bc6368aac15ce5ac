"""Registered queries with their SQL, and storage that ends a plan's lineage."""
