"""Operators for preparing large text corpora: deduplication, language
identification, tokenisation, packing, search and personal-data detection.

Nothing else in the library imports this subpackage.
"""
