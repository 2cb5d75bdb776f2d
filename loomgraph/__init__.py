"""loomgraph: code-graph analytics, retrieval and corpus operators on PySpark."""
