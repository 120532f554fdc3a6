"""DataFrame -> DataFrame operators; each is usable through ``df.transform``."""
