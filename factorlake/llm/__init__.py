"""Operators for preparing training data: near duplicates, quality, archives, mixing, secrets, encoding, sharding, toxicity."""
