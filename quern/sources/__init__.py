"""Readers and writers: files in, versioned tables out."""
