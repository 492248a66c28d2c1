"""glyphmill: Spark-native evaluation and collection of document text."""
