"""Operators of a training-data pipeline: one module each, their registered queries and SQL twins.

Nothing else in the library imports this package.
"""
