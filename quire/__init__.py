"""quire: a PySpark-native analytics engine for scientific manuscripts."""
