"""Graph structure queries (components, trees, blocks, certificates) on Spark DataFrames."""
