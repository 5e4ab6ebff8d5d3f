"""Training-data operators: filters, deduplication, tokenizing, packing, search."""
