"""Operators for text corpora: names, places, privacy, language, duplicates, tokens, packing.

Nothing outside this package imports it.
"""
