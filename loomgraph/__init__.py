"""loomgraph: property-graph, RDF and table analytics as plain PySpark DataFrame operators."""
