"""textloom: analytics, governance and preparation of text content on Spark DataFrames."""
