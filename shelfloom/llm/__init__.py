"""Training-data operators: dedup, mixing, extraction, tokenising, scoring."""
