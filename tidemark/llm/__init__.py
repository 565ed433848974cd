"""Training-data operators: text quality, near copies, privacy, tokenisation, extraction.

Nothing else in the library imports this subpackage.
"""
