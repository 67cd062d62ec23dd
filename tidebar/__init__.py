"""tidebar: a Spark-first engine for time-series analytics over regularly sampled bars."""
