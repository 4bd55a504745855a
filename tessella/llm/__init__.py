"""Training-data operators: deduplication, mixing, formatting, filtering, archives and media."""
