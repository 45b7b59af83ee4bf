"""The three questions answered over observations, and the registered queries."""
