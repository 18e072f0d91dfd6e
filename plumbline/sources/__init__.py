"""Reading and writing tables and documents."""
