"""Session set-up and the catalogue of queries."""
