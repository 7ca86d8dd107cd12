"""Evidence analytics expressed as PySpark DataFrame plans."""
