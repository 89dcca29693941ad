"""Column functions: vectors, places, times, texts, hashes, images."""
