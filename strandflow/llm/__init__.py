"""Training-data operators: text, media and chat columns at corpus scale."""
