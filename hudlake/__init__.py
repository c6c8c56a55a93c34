"""Screenshot-text extraction and corpus preparation on Spark."""
