"""Reading landed files, records, sheets and relational tables."""
