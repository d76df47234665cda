"""Training-data operators: scoring, mixing, language ID, token counts, decontamination, near-dedup, ANN, toxicity, secrets, WARC."""
