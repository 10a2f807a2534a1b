"""Training-data operators: scoring, filtering, deduplication, encoding, packing and exact search over text tables.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface and a thin
query ``opN_<name>(spark, sf_dir)`` which applies it to a whole table; ``registry`` collects the queries.
"""
