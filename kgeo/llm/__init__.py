"""Training-data operators at corpus scale: near-duplicates, language, tokens, packing, search and filters.

Nothing outside this folder imports it. Operators live in one module each; ``queries`` registers them."""
