"""heddle: composable analytics operators written directly on Spark DataFrames."""
