"""tidewell: business-table analytics expressed as Spark DataFrames."""
