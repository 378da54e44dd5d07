"""Streams of shots and detections."""
