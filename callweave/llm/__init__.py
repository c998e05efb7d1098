"""Training-corpus operators: tokenising, deduplication, filtering, mixing, archives."""
