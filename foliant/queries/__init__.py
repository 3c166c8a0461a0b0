"""Named queries of the library's own operators, by family."""

from . import activity, captable, crm, documents, entities, evidence, ledger, markdown, outlines, parsing, payloads, people, persons, retrieval, reviews, rules, scalars, states

__all__ = ["activity", "captable", "crm", "documents", "entities", "evidence", "ledger", "markdown", "outlines", "parsing", "payloads", "people", "persons", "retrieval", "reviews", "rules", "scalars", "states"]
