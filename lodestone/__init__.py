"""A relational analytics engine whose operators are declared as Spark DataFrame plans."""
