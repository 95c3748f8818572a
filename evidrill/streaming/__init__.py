"""The evidence models work on complete tables and have no streaming form; new batches are scored by running a plan again,
for which evidrill.plans.cache keeps results under digests of their data."""
