"""Job-posting and text analytics as Spark DataFrame operators."""
