"""Where tables are read from and how they are changed."""
