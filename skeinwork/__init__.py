"""skeinwork: relational, graph, vector and full-text queries over one set of Spark DataFrames."""

__version__ = "0.1.0"
