"""Operators for preparing large text and vector corpora for model training.

Nothing outside this subpackage imports it.  Each operator module keeps a general
interface; ``queries`` holds the thin, registered queries built on them.
"""
