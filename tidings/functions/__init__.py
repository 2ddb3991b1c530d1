"""Column expressions: text, entities, dates, keyword rules."""
