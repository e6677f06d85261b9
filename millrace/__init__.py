"""millrace: data-pipeline operators on Spark DataFrames."""
