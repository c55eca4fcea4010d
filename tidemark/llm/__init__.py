"""Operators for large training corpora: filters, deduplication, extraction, packing.

Each module holds one operator with its own general interface; `queries` wraps
them as registered queries over the test tables. Nothing outside this package
imports it except the driver's entry file.
"""
