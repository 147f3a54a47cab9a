"""Column-level functions: strings, dates, tokens, tables, images, ids."""
