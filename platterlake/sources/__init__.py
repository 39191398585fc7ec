"""Reading disc images."""
