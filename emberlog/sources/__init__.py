"""Files: segments, logs and foreign databases."""
