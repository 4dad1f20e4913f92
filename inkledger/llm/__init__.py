"""Training-data operators over the texts, files and signatures of the review."""
