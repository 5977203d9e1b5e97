"""terrasift: a Spark-first urban land analytics engine."""
