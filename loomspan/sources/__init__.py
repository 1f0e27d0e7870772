"""Readers and writers: JSON lines with issue codes, strict JSON, write-once sinks, manifests."""
