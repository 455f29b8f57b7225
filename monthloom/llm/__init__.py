"""Operators for building training corpora: filters, near-duplicate and decontamination joins, packing, token files."""
