"""colloquy: conversational search, ranking analytics and corpus preparation on PySpark."""
