"""Operators for preparing large text corpora: sharding, filtering, deduplication, mixing."""
