"""kinfold: record linkage and corpus operators on Spark DataFrames."""
