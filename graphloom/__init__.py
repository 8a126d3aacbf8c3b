"""graphloom: Spark-native analytics over large labelled directed graphs."""
