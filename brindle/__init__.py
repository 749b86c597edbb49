"""brindle: a warehouse-style analytics library on PySpark."""
