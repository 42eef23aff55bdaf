"""End-to-end jobs (detection, training, retraining) and the query catalogue."""
