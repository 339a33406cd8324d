"""Entity linking, fielded retrieval and ranking over knowledge bases, as Spark DataFrame plans."""
