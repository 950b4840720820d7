"""Training-data operators: scanning, filtering, deduplicating, mixing and packing text tables."""
