"""Operators for preparing training text: deduplication, filters, scores, mixing, token counts.

Nothing else in the library imports this subpackage.
"""
