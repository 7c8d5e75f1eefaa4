"""Relational and graph operators over plain DataFrames of nodes, edges, roots and owners."""
