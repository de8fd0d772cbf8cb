"""Column functions: regular-expression dialects, text measures, decoders, finding attributes."""
