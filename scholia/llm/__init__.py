"""Training-data operators: archives, duplicates, languages, leaks, personal data, quality, packing."""
