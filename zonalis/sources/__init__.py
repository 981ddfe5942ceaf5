"""Tile planning and audit, the tile and pixel tables, and the layer catalog."""
