"""Readers of result archives, annotations and images, and table sinks."""
