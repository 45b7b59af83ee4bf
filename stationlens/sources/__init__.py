"""Report files in, Parquet layouts out."""
