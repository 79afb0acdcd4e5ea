"""plazaflow: a Spark-first engine for city-agenda records."""
