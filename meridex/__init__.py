"""PySpark-native analytics for short clinical text: triage rules, dataset quality and metrics."""
