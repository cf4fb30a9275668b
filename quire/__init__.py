"""quire: page-layout and corpus analytics on Spark DataFrames."""
