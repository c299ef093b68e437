"""Training-data operators: archives, page text, tokens, near copies, quality, mixing."""
