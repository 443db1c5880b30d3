"""Operators for training-data pipelines: one module per operator, `queries` registers them.

Nothing outside this package imports it; removing the folder leaves the rest of the library whole.
"""
