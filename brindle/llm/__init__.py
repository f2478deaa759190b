"""Training-data operators over text and vector tables; nothing outside imports this package."""
