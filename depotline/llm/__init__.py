"""Operators for large text corpora: near duplicates, line dedup, language,
toxicity, personal data, mixing, packing, vector search and token files.

Every operator is a function over DataFrames in a module of its own;
``queries`` registers one query for each over the given tables.  Nothing
outside this package imports it.
"""
