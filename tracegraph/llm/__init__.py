"""Operators for preparing training text, apart from the code-graph library; nothing else imports them."""
