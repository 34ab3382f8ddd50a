"""Sources that turn files into text chunks, and sinks for the reports."""
