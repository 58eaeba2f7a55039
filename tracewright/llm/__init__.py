"""Training-data operators: near-duplicates, classifiers, packing, mixing, media, tokens, chat."""
