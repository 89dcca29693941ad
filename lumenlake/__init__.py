"""Photo-library analytics as DataFrame operators, and operators for training-data corpora."""
