"""Credit-portfolio analytics as lazy PySpark DataFrame operators."""
