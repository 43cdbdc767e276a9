"""Analytical questions over the history tables.

``t`` is anything that maps a table name to a DataFrame: the store, the star adapter or a plain dict.
"""
