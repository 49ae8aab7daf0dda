"""Whole transcription plans around a plug-in scorer and decoder."""
