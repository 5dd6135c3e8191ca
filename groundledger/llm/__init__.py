"""Operators for preparing training data; queries over the given tables are in ``queries``."""
