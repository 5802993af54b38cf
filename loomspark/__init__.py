"""loomspark: a PySpark-native analytics engine for tables, intervals, sequences, variants and matrices."""
