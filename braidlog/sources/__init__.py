"""Reading of log files and catalogues, and the file system they are in."""
