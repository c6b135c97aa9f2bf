"""Training-data operators: near-duplicates, quality, sharding, tokens, archives, licences, toxicity.

Nothing else in the library imports this subpackage.
"""
