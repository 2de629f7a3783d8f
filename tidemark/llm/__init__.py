"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it; ``queries.py`` and ``oracles.py`` register its
queries and their SQL.
"""
