"""Campaign-mail analytics and corpus preparation on Spark DataFrames."""
