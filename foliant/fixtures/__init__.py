"""A PDF writer for tests, queries and the benchmark. It shares nothing with the reader."""
