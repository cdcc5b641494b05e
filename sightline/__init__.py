"""Analytics over detections, tracks, packets, motion, embeddings and audio, as Spark DataFrames."""
