"""docmill: document and event analytics expressed as Spark plans."""
