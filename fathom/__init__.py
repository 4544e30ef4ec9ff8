"""fathom: a Spark-native analytics library for documented code bases."""
