"""Training-data operators: mixing, search, filtering, de-duplication, extraction, packing, encoding."""
