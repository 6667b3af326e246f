"""evenkeel: binary scoring on imbalanced tables, as Spark DataFrame operators."""
