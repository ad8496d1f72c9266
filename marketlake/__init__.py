"""marketlake: a Spark-native market-data lake and point-in-time analytics engine."""
