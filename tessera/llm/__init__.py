"""Training-data operators: extraction, deduplication, scoring, tokenizing, sharding and rendering of text corpora."""
