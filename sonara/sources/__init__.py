"""Readers and writers: WAV and raw float audio, tokenizer and phrase files, benchmark documents."""
