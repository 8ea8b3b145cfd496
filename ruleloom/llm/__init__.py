"""Operators for training data and the queries that use them; nothing else imports this package."""
