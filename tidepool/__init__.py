"""tidepool: associative recall, text search and data processing over Spark DataFrames."""
