"""Nothing here: all work is in batches, and no operator keeps state over a stream."""
