"""Sparkloom: retrieval, evaluation and activity analytics expressed as Spark plans."""
