"""Ready-made plans over tables."""
