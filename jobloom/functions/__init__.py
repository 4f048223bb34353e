"""Column functions: normalization of text, fields, links and identities."""
