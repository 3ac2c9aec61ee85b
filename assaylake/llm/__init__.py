"""Operators for large training corpora: ten methods and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
