"""DataFrame operators of curation, storage and search."""
