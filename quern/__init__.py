"""quern: document retrieval and curation analytics as composable Spark DataFrame operators."""
