"""Scalar functions and value semantics as Spark columns."""
