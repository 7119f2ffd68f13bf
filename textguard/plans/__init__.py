"""Event analytics, roll-ups, corpus preparation and evaluation."""
