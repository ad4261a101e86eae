"""Training-data operators: extraction, deduplication, decontamination, filtering, archives and token output."""
