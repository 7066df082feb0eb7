"""Operators: content, text, pages, forms, redaction; documents as relations; relational operators."""
