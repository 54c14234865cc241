"""Inputs: files on storage, text tables, the templated code corpus, rule packs."""
