"""Operators that prepare training text: tokens, de-duplication, quality, mixing, shards.

Nothing else in the library imports this package.
"""
