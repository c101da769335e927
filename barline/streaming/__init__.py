"""Bars and gap signals over streams: an extension of the batch queries."""
