"""Readers and writers of mention corpora, embeddings, assignments and trees."""
