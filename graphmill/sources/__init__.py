"""Scans and sinks: source discovery, manifests, contracts, fact tables, reports."""
