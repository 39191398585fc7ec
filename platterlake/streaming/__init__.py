"""Images arriving in a folder."""
