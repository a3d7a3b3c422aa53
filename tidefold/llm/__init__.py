"""Operators for preparing training text: filters, detectors, near-duplicates.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``registry`` wires the operators to the tables.
"""
