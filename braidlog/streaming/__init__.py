"""Incremental jobs: new node files into merged days, new logs into a catalogue, each once."""
