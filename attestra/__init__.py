"""Evidence-based verification and training-text operators on Spark."""
