"""Training-data operators: language ID, packing, chat formatting, near and exact
deduplication, quality rules, media columns, source mixing and toxicity.

Nothing else in the library imports this subpackage.
"""
