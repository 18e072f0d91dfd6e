"""Column expressions shared by the operators; none of them needs a UDF."""
