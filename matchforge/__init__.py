"""matchforge: football-data analytics and corpus preparation as Spark jobs."""
