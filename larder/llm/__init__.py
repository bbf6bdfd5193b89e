"""Operators of a training-data pipeline over the ``documents`` table.

One module per operator (``op*`` queries are registered in ``queries.py``);
nothing else in the library imports this package.
"""
