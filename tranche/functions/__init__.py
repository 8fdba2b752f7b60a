"""Column expressions: text cleaning, guards and display formats."""
