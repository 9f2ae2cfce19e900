"""Tables, files and the versioned store."""
