"""Readers and writers of text formats and source detection."""
