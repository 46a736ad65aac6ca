"""Corvella: semantic search over source trees and text collections, as Spark plans."""

__version__ = "0.1.0"
