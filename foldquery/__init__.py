"""Search for RNA secondary-structure patterns as Spark plans."""
