"""Operators for language-model training data; nothing else imports them."""
