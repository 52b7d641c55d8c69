"""A Spark-native analytics engine: declarative plans on DataFrames and SQL, Catalyst does the rest."""
