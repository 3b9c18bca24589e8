"""Text-provenance data work on Spark: split, format, tokenize, batch, pair,
score, evaluate and retrieve texts at corpus scale."""
