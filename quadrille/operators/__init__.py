"""Operators over frames of solutions."""
