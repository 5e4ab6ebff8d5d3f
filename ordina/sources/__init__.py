"""Readers, decoders, fixture generators and writers."""
