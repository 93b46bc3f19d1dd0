"""Facts, examples, stored databases and the grammar of their names."""
