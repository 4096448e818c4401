"""Running tensors over streams: an addition, for cells that arrive as events."""
