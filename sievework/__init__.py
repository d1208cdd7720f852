"""Sievework: curation queries over large item collections, as Spark plans."""
