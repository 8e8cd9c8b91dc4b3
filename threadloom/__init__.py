"""Code-graph analytics on Spark: typed tables of files, symbols, edges and references, and the queries over them."""
