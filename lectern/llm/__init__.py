"""Training-data operators: mixing, deduplication, classifiers, scans, sketches and packing."""
