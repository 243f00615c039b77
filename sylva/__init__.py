"""sylva: text annotation, co-occurrence and data-preparation operators on Spark DataFrames."""
