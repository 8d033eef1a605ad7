"""Views over the supplied tables and the registered queries."""
