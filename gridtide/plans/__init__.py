"""How rows are laid out: series order and blocks, value order, statistics joined back to rows."""
