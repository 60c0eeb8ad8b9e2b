"""functions of loomgraph."""
