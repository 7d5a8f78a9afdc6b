"""Resumable lanes as Structured Streaming: an extension beyond batch runs."""
