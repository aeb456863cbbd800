"""Search, graph and analytics operators over linked records, as plain PySpark DataFrame functions."""
