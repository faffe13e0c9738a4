"""loomgraph: a PySpark-native engine for knowledge graphs, text and context assembly."""
