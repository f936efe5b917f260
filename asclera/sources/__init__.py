"""Readers and writers: file listings, delimited text, JSON landing, FHIR, VCF, tables."""
