"""Training-data operators over text tables; nothing outside this folder imports it."""
