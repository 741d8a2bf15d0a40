"""agestrata: age-structured contributor analytics as PySpark DataFrame plans."""
