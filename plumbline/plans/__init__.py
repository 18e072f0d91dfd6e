"""From a plan to a tuned, evaluated and diagnosed model."""
