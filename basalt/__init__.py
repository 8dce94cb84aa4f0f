"""basalt: a compact relational plan API lowered to Spark DataFrames."""
