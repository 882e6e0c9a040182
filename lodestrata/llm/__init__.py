"""Training-data operators: dedup, token counts, chat formatting, quality rules, packing, encoding, extraction, fingerprints, LM scores."""
