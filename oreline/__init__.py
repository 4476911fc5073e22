"""oreline: specification-mining analytics as lazy PySpark DataFrame operators."""
