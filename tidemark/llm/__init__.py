"""Training-data operators: dedup, scoring, tokens, packing, decontamination."""
