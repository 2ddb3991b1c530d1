"""Operators of a training-data pipeline: duplicates, token files, quality, privacy, packing and so on.

Nothing else in the library imports this subpackage. Each operator module has a general interface
over any frame; `queries` applies them to the test tables.
"""
