"""Pure functions from bytes to tokens, objects and file indexes; no Spark."""
