"""framescan - prompt-injection scanning of JSON-RPC frames and text corpora on Spark."""

__version__ = "0.1.0"
