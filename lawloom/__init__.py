"""lawloom: analytics over legislative text, declared on the DataFrame and SQL API."""
