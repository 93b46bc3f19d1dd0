"""Analytics beside the rules: mining, embeddings, weights of words, messages."""
