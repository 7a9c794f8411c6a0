"""Tables, derived views, stored listing pages and boundary files."""
