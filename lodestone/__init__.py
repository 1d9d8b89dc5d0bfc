"""lodestone: relational analytics over code and schema facts, on Spark DataFrames."""
