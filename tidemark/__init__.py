"""Point-in-time market research jobs written as PySpark DataFrame programs."""
