"""What the catalogue's queries are asked with, in Spark and in SQL alike."""

from __future__ import annotations

#: The owner asked for where an operator reads one owner's memories, and the time "now".
OWNER, AS_OF = "qiaoyun", "2026-09-01 00:00:00"
#: Phrases searched for.
KEYWORDS = ("notes_", "采购清单", "LOGBOOK", "re", "see memo", "教训", "nothing holds this")
#: And the pattern of those taken from memories.
KEYWORD = "[a-z0-9_一-鿿]{4,8}"
#: Texts that memories are called to mind by, and nodes (query, rank, node) that walks start from.
PROMPTS = ((0, "the trial battery and the 报销凭证"), (1, "anonymous sketch"), (2, "采购清单 was here"))
SEEDS = ((0, 1, "n5"), (0, 2, "n0"), (1, 1, "n7"), (1, 2, "n9"), (2, 1, "n11"), (2, 2, "n11"), (3, 1, "absent"))
