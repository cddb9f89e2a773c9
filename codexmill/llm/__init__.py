"""Training-data operators. Nothing outside this folder imports them but the entry point, under a guard."""
