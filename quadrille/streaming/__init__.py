"""The commit log as a stream."""
