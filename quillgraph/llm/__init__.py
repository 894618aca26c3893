"""Operators of a training-data pipeline (one module an operator).

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
