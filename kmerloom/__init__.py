"""kmerloom: sequence features, quality control and corpus preparation on PySpark."""
