"""crawlframe: crawl analytics as relational algebra over Spark DataFrames."""
