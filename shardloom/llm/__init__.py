"""Operators for building training corpora: dedup, sharding, search, language, packing, tokenizers, licences."""
