"""Where rasters come from and go to."""
