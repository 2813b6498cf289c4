"""Training-data operators: dedup, quality, secrets, mixing, packing and language identification."""
