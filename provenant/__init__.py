"""Citation provenance over messages, page reads and libraries, as Spark jobs."""
