"""Column functions: text in :mod:`text`, geometry in :mod:`boxes`."""
