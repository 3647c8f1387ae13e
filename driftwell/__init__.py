"""driftwell: data-quality, model-monitoring and corpus operators as DataFrame-to-DataFrame functions."""
