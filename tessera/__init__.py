"""tessera: a SQL-dialect analytics engine that plans onto PySpark DataFrames."""
