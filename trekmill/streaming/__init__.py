"""The same operators over streams."""
