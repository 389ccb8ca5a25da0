"""Route analytics over trail networks as Spark DataFrame programs."""
