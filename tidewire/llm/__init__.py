"""Training-data operators: filtering, counting, packing, identification, mixing, archives, scoring, near duplicates, neighbours."""
