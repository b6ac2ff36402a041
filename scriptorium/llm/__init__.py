"""Training-data operators: thirteen corpus-scale jobs that stand apart from the rest.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
