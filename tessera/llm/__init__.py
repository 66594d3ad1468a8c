"""Operators for preparing training corpora: sharding, deduplication, extraction, archives, filtering, mixing, scoring."""
