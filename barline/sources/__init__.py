"""Where panels come from: derived bars, files, and the simulator."""
