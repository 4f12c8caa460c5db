"""Plans over the operators, and the registered queries."""
