"""Training-data operators: tokens, packing, similarity, search and language.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries.py`` holds the thin registered queries.
"""
