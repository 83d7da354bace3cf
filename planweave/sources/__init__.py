"""Tables, files and result lines."""
