"""The function library: names and argument orders of Trino-flavoured SQL, as Spark expressions."""
