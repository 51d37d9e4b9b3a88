"""Training-data operators: fingerprints, dedup, language ID, licences, mixing, packing, search."""
