"""Readers and writers of content formats: files to tables of blocks (path, seq, block_id, text, ...)."""
