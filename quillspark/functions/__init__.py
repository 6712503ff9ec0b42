"""Column functions: text, money, dates, nested documents."""
