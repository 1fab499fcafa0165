"""glyphmill: character-data and property-table analytics on Spark DataFrames."""
