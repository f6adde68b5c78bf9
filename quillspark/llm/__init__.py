"""Training-data operators: token counts, toxicity, deduplication, scans, decontamination, encoding."""
