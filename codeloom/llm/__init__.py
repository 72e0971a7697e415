"""Training-data operators: deduplication, tokenisation, packing, formatting,
archives, language-model scoring and quality classification.

Nothing outside this subpackage imports it.
"""
