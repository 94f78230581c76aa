"""Market-panel analytics on PySpark: DataFrame in, DataFrame out."""
