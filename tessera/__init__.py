"""tessera: a PySpark-native analytics library of DataFrame -> DataFrame operators."""
