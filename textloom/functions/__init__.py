"""Column functions: text cleaning, segmentation, URLs, scores."""
