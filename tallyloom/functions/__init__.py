"""Column functions: text, hashing, classifiers, scores, and the few Arrow UDFs."""
