"""Training-data operators over documents, pages and embeddings, each by its own named method."""
