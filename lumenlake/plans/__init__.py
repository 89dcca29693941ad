"""Query planning and the registered queries."""
