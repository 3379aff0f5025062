"""newsloom: a Spark-first engine for news feeds, play-by-play and corpus preparation."""
