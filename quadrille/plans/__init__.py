"""Queries as trees: the algebra, the parser, rewrites, and the compiler to DataFrames."""
