"""Spark-native citation-span analytics: extraction, resolution, scoring and audit as DataFrame plans."""
