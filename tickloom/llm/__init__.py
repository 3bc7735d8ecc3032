"""Training-data operators: language, media, scoring, packing, dedup, quality, mixing and token counts."""
