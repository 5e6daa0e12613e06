"""nearfield: vector analytics expressed as Spark DataFrame operations."""
