"""End-to-end compositions: dataset preparation, training, screening."""
