"""dialoom: Spark-first curation of conversation, text and image-caption training data."""
