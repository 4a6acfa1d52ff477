"""Training-data operators: packing, tokenizing, classifying, deduplicating and extracting text at corpus scale."""
