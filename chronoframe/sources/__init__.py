"""Where version logs are read from and written to."""
