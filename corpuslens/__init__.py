"""Questions about large collections of repositories, notes and documents, as Spark jobs."""
