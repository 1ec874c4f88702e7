"""Training-data operators: cleaning, deduplication, scoring, formatting,
mixing and encoding of text corpora."""
