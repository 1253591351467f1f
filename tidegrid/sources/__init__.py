"""Reading, header normalisation and writing."""
