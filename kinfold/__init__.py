"""kinfold: similarity search and content identity on Spark DataFrames."""
