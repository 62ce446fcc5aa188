"""tidewatch: trend analytics over tables and streams of public posts, as Spark jobs."""
