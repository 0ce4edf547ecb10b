"""Every query of the core and its SQL."""

from __future__ import annotations

from . import contract, formats, indexing, selection  # noqa: F401  they add their queries to those of contract

QUERIES, SQL, flagship = contract.QUERIES, contract.SQL, contract.flagship
