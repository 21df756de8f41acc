"""Training-data operators.  Nothing outside this folder (but the guarded lookup in ``__spark_entry__``) imports it."""
