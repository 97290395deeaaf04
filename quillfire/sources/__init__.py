"""Reading documents and keeping collections."""
