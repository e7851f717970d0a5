"""millrace: document ranking, profile analytics and text operators as PySpark DataFrame operators."""
