"""Training-data operators: scoring, filtering, deduplication, encoding and extraction at corpus scale."""
