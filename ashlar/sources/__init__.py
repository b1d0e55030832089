"""Tables: the catalogue of a directory, and stored tables that can be changed."""
