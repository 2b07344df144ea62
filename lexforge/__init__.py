"""lexforge: DataFrame-native analytics over documentation and code-knowledge records."""
