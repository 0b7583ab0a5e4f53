"""Support-content and machine-log analytics as plain DataFrame functions."""
