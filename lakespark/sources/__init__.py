"""Import, export, and the streaming source."""
