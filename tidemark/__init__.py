"""tidemark: daily equity analytics expressed as PySpark DataFrame operators."""
