"""Training-data operators: tokenising, near-duplicates, language, decontamination, filtering."""
