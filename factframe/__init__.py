"""factframe: analytics over dated facts, written as Spark DataFrame transformations."""
