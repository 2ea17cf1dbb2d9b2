"""proofsheet: Spark-native artwork-compliance analytics."""
