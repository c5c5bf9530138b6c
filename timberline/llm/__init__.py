"""Operators for preparing training data at large scale.

Nothing else in the library imports this subpackage.
"""
