"""A vector and record engine written against the Spark DataFrame API."""
