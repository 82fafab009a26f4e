"""Panel analytics on PySpark: long tables of time series `(unique_id, ds, y)`."""
