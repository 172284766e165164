"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  ``queries.py`` holds the registered
queries, ``sql.py`` the SQL they are compared with.
"""
