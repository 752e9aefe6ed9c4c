"""Training-data operators: filters, deduplication, search, formatting, packing."""
