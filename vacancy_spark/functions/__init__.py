"""Column -> Column helpers: text, dates, UK regions."""
