"""Runnable jobs over the library; each module has a command line and a config file of the same name."""
