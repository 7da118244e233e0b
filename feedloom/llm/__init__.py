"""Training-data operators: similarity joins, search, filters, tokenizers and the corpus pipeline.

Nothing outside this package imports it, so it can be removed as a whole.
"""
