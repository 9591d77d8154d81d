"""Training-data operators: deduplication, filtering, redaction, packing, formatting."""
