"""Training-data operators: ten corpus operations and the queries that apply them.

Nothing outside this package imports it.
"""
