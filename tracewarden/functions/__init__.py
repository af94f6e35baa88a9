"""Column expressions: decoding, URI shapes, text features, scores."""
