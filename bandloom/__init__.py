"""Radio-spectrometer analytics on Spark."""
