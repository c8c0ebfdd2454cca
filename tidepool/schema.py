"""Schemas of the tables and files, stated in full; nothing is inferred."""

from __future__ import annotations

MEMORIES = (
    "id bigint, owner string, type string, content string, tags string, ts string, confidence double, status string, source string, "
    "created_at string, updated_at string, layer string, event_time string, heat double, last_sparked_at string, hit_count int"
)
#: Columns that are read where there are any and that no stored table need have.
OPTIONAL = {"self_relevance": "double", "narrative_id": "string", "block_id": "string"}
#: Entries of the ledger beside a memory table: what changed of a memory, and when; null is unchanged.
LEDGER = "id bigint, seq bigint, at string, status string, heat double"
IDENTITY = "id bigint, content string, tags string, importance double"
CONFLICTS = "topic string, weak_point double, threshold double"
NODES = "id string, title string, type string, ord bigint"
EDGES = "src string, dst string, relation string, ord bigint"
GOLD = "context string, label string"
TOOLS = "tools array<struct<name: string, description: string>>"
MODEL = "w map<string,double>, b double, meta map<string,string>, version string, lex struct<idf: map<string,double>, avgdl: double, n: int>"
TURNS = "owner string, counter bigint, user string, assistant string, at string"
