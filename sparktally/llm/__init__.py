"""Training-data operators: dedup, mixing, scanning, language ID, tokenising, PII, media columns."""
