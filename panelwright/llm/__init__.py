"""Training-data operators: scoring, deduplication, decontamination, packing,
sharding, extraction, token counts and archives over document tables."""
