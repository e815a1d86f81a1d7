"""Training-data operators: deduplication, scoring, search, mixing and packing of document tables.

Nothing else in the package imports this one. Each operator is a function from DataFrames to a
DataFrame; `queries` registers one query for each of them.
"""
