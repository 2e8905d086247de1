"""Schemas, the projection of driver tables onto the ledger, and the catalogue of registered queries."""
