"""Training-data operators: cleaning, filtering, deduplication, tokenizing."""
