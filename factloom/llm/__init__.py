"""Operators for preparing training text: scans, filters, duplicates, mixing and token files.

Nothing outside this package imports it, except the driver contract, which works without it.
"""
