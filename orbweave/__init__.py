"""Orbweave: vector, graph, key-value and text queries over Spark DataFrames."""
