"""loomgraph: a PySpark-native code-graph analytics engine."""
