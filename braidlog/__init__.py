"""Object-centric event-log analytics expressed as Spark DataFrame plans."""
