"""How tables of orders, parts, documents and events stand in for the graph's tables, and the registered queries."""
