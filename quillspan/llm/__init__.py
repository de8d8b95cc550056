"""Training-data operators: deduplication, scoring, decontamination, packing, token counts."""
