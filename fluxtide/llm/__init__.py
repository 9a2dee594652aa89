"""Operators for large training-text pipelines, one module each; nothing else imports this."""
