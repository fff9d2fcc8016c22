"""Source-corpus analytics on Spark: file trees in, tables and reports out."""
