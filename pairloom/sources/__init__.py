"""Reading dataset folders and writing corpora and predictions."""
