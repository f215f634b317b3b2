"""assayforge."""
