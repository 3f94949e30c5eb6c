"""Dense, sparse and binary vectors in DataFrames: arithmetic, search, clustering, descriptors and files."""
