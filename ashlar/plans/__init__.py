"""From statements to plans: the SQL dialect, plan inspection, the console, the registered queries."""
