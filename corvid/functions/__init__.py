"""Column functions, all from Spark built-ins but for Unicode normalisation."""
