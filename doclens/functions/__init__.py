"""Column functions: text, numeric features and scores."""
