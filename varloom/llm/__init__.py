"""Training-data operators: dedup, quality, search, decontamination, mixing, formatting, archives."""
