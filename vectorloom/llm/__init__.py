"""Training-data operators: thirteen scale-out text operators and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
