"""Column functions: patterns, spans, checksums, masks, text clean-up."""
