"""The engine as one object: memories, graph and selector of a store, and what is asked of them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.config import PROTECTED_MARKERS, STOP_WORDS, Heat, Walk, Write
from tidepool.functions.text import concepts, event_time
from tidepool.operators import gates, graph, heat, journal, recall, records, search
from tidepool.sources import stores
from tidepool.sources.shared import cut, drop


class Engine:
    """Reads and grows a memory table; every answer is a DataFrame or a small result for display."""

    def __init__(self, spark: SparkSession, memories: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, owner: str = "me") -> None:
        self.spark, self.path, self.owner = spark, memories, owner
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], "id string, title string, type string, ord bigint")
        self.edges = edges if edges is not None else spark.createDataFrame([], "src string, dst string, relation string, ord bigint")

    @property
    def memories(self) -> DataFrame:
        """All memories with their status and heat by now: every reader sees what the ledger says."""
        return stores.current_table(self.spark, self.path)

    @property
    def available(self) -> bool:
        return stores.exists(self.spark, self.path)

    # -- write chain ------------------------------------------------------------------------------

    def write(self, rows: DataFrame, now: str, p: Write = Write()) -> DataFrame:
        """Write new texts (content, tag), in the order of ``place``; returns (place, id, verdict).

        Verdicts: shell, noise, blocked:<id of the core memory it contradicts>, duplicate:<id>, saved.
        New rows are compared with the owner's latest active memories and with each other. A memory that
        a saved one supersedes gets an entry in the ledger, which all readers follow; the table itself
        is only appended to.
        """
        held = self.memories
        top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
        text = rows.select("place", "content", "tag", gates.gate(F.col("content"), p).alias("gate"))
        passed = text.where("gate = 'pass'").select("place", "content", "tag")
        numbered = records.numbered(passed.withColumn("owner", F.lit(self.owner)), "owner", "place", "k").withColumn("id", F.lit(top) + F.col("k"))
        fresh, fresh_path = cut(numbered.select("id", "owner", "place", "content", "tag"), "fresh")
        latest = records.recent(held.where(F.col("owner") == self.owner), p.dedup_window).select("id", "owner", "content").join(held.select("id", "tags"), "id")
        both = latest.unionByName(fresh.select("id", "owner", "content", F.to_json(F.array("tag")).alias("tags")))
        core = held.where((F.col("owner") == self.owner) & (F.col("layer") == "core") & (F.col("status") == "active"))
        blocked, blocked_path = cut(gates.core_conflicts(fresh, core), "blocked")
        both = both.join(blocked, "id", "left_anti")
        repeats = gates.duplicates_recent(both, p).select("id", "duplicate_of")
        good = fresh.join(repeats, "id", "left_anti").join(blocked, "id", "left_anti")
        replaced = gates.supersedes(both.join(repeats, "id", "left_anti"), p).join(good.select("id"), "id", "left_semi")
        at = F.lit(now)
        told = event_time(F.col("content"), F.lit(now).cast("timestamp_ntz"))
        saved = good.select(
            "id", "owner", F.lit("event").alias("type"), "content", F.to_json(F.array("tag")).alias("tags"), at.alias("ts"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"),
            F.lit("write").alias("source"), at.alias("created_at"), at.alias("updated_at"), gates.layer_of(F.col("tag")).alias("layer"), F.when(told != "", told).otherwise(at).alias("event_time"),
            F.lit(0.0).alias("heat"), F.lit(None).cast("string").alias("last_sparked_at"), F.lit(0).alias("hit_count"),
        )
        verdicts = text.select("place", "gate").join(fresh.select("place", "id"), "place", "left").join(repeats, "id", "left").join(blocked, "id", "left")
        verdict = F.when(F.col("gate") != "pass", F.col("gate")).when(F.col("core_id").isNotNull(), F.concat(F.lit("blocked:"), "core_id")).when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate:"), "duplicate_of")).otherwise("saved")
        out, _ = cut(verdicts.select("place", F.when(verdict == "saved", F.col("id")).alias("id"), verdict.alias("verdict")), "verdicts")
        stores.append_memories(saved, self.path)
        stores.append_ledger(replaced.select(F.col("outdated").alias("id"), F.col("id").alias("seq"), at.alias("at"), F.lit("outdated").alias("status")), self.path)
        drop(self.spark, fresh_path, blocked_path)
        return out

    def state(self) -> DataFrame:
        """(id, status, heat) of each memory by now."""
        return self.memories.select("id", "status", "heat")

    # -- recall chain -----------------------------------------------------------------------------

    def _texts(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "qid bigint, text string")

    def search(self, keyword: str, limit: int = 5) -> DataFrame:
        keywords = self.spark.createDataFrame([(keyword,)], "keyword string")
        return search.search(self.memories, keywords, self.owner, limit).join(self.memories.select("id", "ts", "tags", "content"), "id").orderBy("rank")

    def concepts(self, text: str) -> list[str]:
        return self._texts(text).select(concepts(F.col("text"), STOP_WORDS).alias("c")).first().c

    def top_concepts(self, text: str, n: int = 5) -> list[str]:
        """The concepts of a text that most of the owner's memories hold, as many first as are asked for; ties as in the text."""
        words = self.concepts(text)
        if not words:
            return []
        rows = self.memories.where((F.col("owner") == self.owner) & (F.col("status") == "active"))
        counts = rows.agg(*(F.count_if(F.contains("content", F.lit(w))).alias(f"n{i}") for i, w in enumerate(words))).first()
        return [words[i] for i in sorted(range(len(words)), key=lambda i: (-counts[i], i))[:n]]

    def light(self, text: str, limit: int = 5) -> DataFrame:
        """Memories that hold a concept of the text exactly, the most concepts first (own design)."""
        words = self.concepts(text)
        rows = self.memories.where((F.col("owner") == self.owner) & (F.col("status") == "active"))
        held = sum((F.coalesce(F.contains("content", F.lit(w)), F.lit(False)).cast("int") for w in words), F.lit(0))
        return rows.withColumn("held", held).where("held > 0").orderBy(F.desc("held"), F.desc(F.col("layer") == "core"), F.desc("id")).limit(limit).select("id", "ts", "tags", "content", "layer", "held")

    def associate(self, text: str, p: Walk = Walk()) -> DataFrame:
        """Memories that the graph calls to mind."""
        adjacent = graph.adjacency(self.edges)
        return recall.prefetch(self._texts(text), self.memories, self.nodes, adjacent, self.owner, p).join(self.memories.select("id", "ts", "content", "layer"), "id").orderBy("rank")

    def premonition(self, n: int = 3) -> DataFrame:
        """The owner's latest memories, newest first (own design)."""
        return records.recent(self.memories.where(F.col("owner") == self.owner), n, newest_first=True)

    def portrait(self, n: int = 5) -> dict[str, list[str]]:
        """Open matters, lessons and theme lines of the owner (own design)."""
        rows = self.memories.where((F.col("owner") == self.owner) & (F.col("status") == "active"))
        marked = lambda mark: [r.content for r in rows.where(F.contains("tags", F.lit(mark))).orderBy(F.desc("id")).limit(n).select("content").collect()]
        themes = rows.groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(n).collect()
        return {"open": marked("待办"), "lessons": marked("教训"), "themes": [f"{r.layer}: {r.n}" for r in themes]}

    def recall(self, text: str) -> dict:
        """The channels of a recall, in their order, as lines."""
        identity = [r.line for r in records.identity(self.memories.where("layer = 'core'"), "confidence").collect()]
        lit = [r.content[:25] for r in self.light(text, 3).collect()]
        near = [(r.content or "")[:25] for r in self.associate(text).limit(3).collect()]
        last = [(r.content or "")[:60] for r in self.premonition(1).collect()]
        weak = [x[:20] for x in self.portrait(2)["lessons"]]
        return {"hit": bool(lit or near), "identity": identity, "lit": lit, "associated": near, "premonition": last, "weak": weak}

    def turn(self, text: str, last: tuple[str, str] | None = None) -> tuple[str, str]:
        """(channel, text) for a turn: settle what the last turn (injected, answer) brought, then the first of lit,
        premonition and background that has an answer."""
        if last is not None:
            row = self.spark.createDataFrame([(self.owner, *last, text)], "owner string, injected string, answer string, next_user string")
            journal.effects(row).withColumn("at", F.current_timestamp().cast("string")).write.mode("append").parquet(self.path.rstrip("/") + "_effects")
        for channel, rows in (("lit", lambda: self.light(text)), ("premonition", lambda: self.premonition(1) if self.concepts(text) else None), ("background", lambda: self.associate(text))):
            found = rows() if text else None
            if found is not None and (lines := [f"- {(r.content or '')[: Walk().line]}" for r in found.collect()]):
                return channel, "\n".join(lines)
        return "none", ""

    def identity_line(self, text: str, cap: int = 6) -> DataFrame:
        """(id, layer, content) of the core memories that share most concepts with a text, at most ``cap`` (own design)."""
        words = self.concepts(text)
        held = sum((F.coalesce(F.contains("content", F.lit(w)), F.lit(False)).cast("int") for w in words), F.lit(0))
        rows = self.memories.where((F.col("owner") == self.owner) & (F.col("layer") == "core") & (F.col("status") == "active"))
        return rows.withColumn("held", held).orderBy(F.desc("held"), F.desc_nulls_last("confidence"), "id").limit(cap).select("id", "layer", "content")

    def sleep(self, as_of: str) -> dict[str, int]:
        """The step before sleep: heat cools, what is old and cold is counted, health is looked at (own design)."""
        summary = heat.decay_summary(self.decay(as_of)).first().asDict()
        return summary | {"compressed": self.compress(as_of).where("compressed").count()} | self.health()

    def organise(self, turns: int, every: int = 20) -> DataFrame | None:
        """Hourly narratives of the owner's memories, every so many turns; nothing between (own design)."""
        if turns % every:
            return None
        rows = self.memories.where(F.col("owner") == self.owner).withColumn("_at", F.try_to_timestamp("created_at").cast("timestamp_ntz")).where("_at IS NOT NULL")
        return recall.narratives(rows, "_at", F.col("owner"), "tags")

    def system_block(self, text: str = "", budget: int = 20) -> str:
        """Lines for a prompt: a cover of the memories, dense near the end, and what the text lights."""
        rows = records.active(self.memories, self.owner)
        total = rows.count()
        if not total:
            return "no memories yet"
        lit = self.light(text, 4).collect() if text else []
        shown = recall.cover(self.memories.where((F.col("owner") == self.owner) & (F.col("status") == "active")), budget if lit or not text else 3)
        lines = [f"- [{r.tags}] {r.content[:80]}" for r in rows.join(shown, "id").orderBy("id").collect()]
        return "\n".join([f"{total} memories, {len(lines)} shown", *lines, *(f"  * {r.content[:60]}" for r in lit), *((["concepts: " + ", ".join(self.top_concepts(text))]) if text else [])])

    def warm_up(self, text: str, cap: int = 10) -> DataFrame:
        """(route, id, content): what each route of recall would bring for a text, at most ``cap`` rows (own design)."""
        routes = [("lit", self.light(text, cap)), ("associated", self.associate(text)), ("latest", self.premonition(cap))]
        parts = [df.select(F.lit(place).alias("place"), F.lit(name).alias("route"), "id", "content") for place, (name, df) in enumerate(routes)]
        return reduce(DataFrame.union, parts).dropDuplicates(["id"]).orderBy("place", "id").limit(cap).select("route", "id", "content")

    def scorecard(self) -> DataFrame:
        """Effects of what was recalled, from one memory of an owner to the next (own rule)."""
        rows = records.numbered(self.memories.select("owner", "id", "content"), "owner", "id", "k")
        later = lambda n, name: rows.select("owner", (F.col("k") - n).alias("k"), F.col("content").alias(name))
        return journal.effects(rows.withColumnRenamed("content", "injected").join(later(1, "answer"), ["owner", "k"], "left").join(later(2, "next_user"), ["owner", "k"], "left"))

    def previews(self) -> DataFrame:
        """Standard objects: head of each memory with its layer and what else the table has of it."""
        return self.memories.select("id", F.substring("content", 1, 30).alias("preview"), "layer", "self_relevance", "narrative_id", "block_id")

    # -- upkeep -----------------------------------------------------------------------------------

    def decay(self, as_of: str, p: Heat = Heat()) -> DataFrame:
        """What heat.decay() makes of the memories; the new heat of those that changed goes to the ledger."""
        done, _ = cut(heat.decay(self.memories, as_of, p), "decayed")
        stores.append_ledger(done.where("changed").select("id", F.lit(0).alias("seq"), F.lit(as_of).alias("at"), F.col("new_heat").alias("heat")), self.path)
        return done

    def rhythm(self, p: Heat = Heat()) -> DataFrame:
        return heat.histogram(self.memories.where(F.col("owner") == self.owner), p)

    def compress(self, as_of: str, days: int = 30) -> DataFrame:
        return recall.compress(self.memories.where(F.col("owner") == self.owner), as_of, days)

    def weave(self, least: int = 2) -> DataFrame:
        """Pairs of labels that occur together, as candidates for edges (own design)."""
        from tidepool.operators.unpack import unpack_values

        return graph.cooccurrence(unpack_values(self.memories, "id", "tags"), "id", "tag", least)

    def themes(self) -> DataFrame:
        return graph.partition(self.edges)

    def overview(self) -> DataFrame:
        return records.ledger(self.memories)

    def health(self) -> dict[str, int]:
        """Counts of what is not as it should be (own design)."""
        m = self.memories
        bad = {"no_owner": F.col("owner").isNull(), "no_content": F.coalesce(F.col("content"), F.lit("")) == "", "bad_heat": F.coalesce(F.col("heat"), F.lit(0.0)) < 0, "unknown_status": ~F.coalesce(F.col("status"), F.lit("")).isin("active", "outdated")}
        return m.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), *(F.count_if(c).alias(k) for k, c in bad.items())).first().asDict()

    def parameters(self) -> dict:
        return {"heat": vars(Heat()), "write": {k: v for k, v in vars(Write()).items() if k != "noise"}, "walk": vars(Walk()), "protected": PROTECTED_MARKERS}

    # -- tools for an agent -----------------------------------------------------------------------

    def tools(self) -> list[dict]:
        text = {"type": "string"}
        return [
            {"name": "recall", "parameters": {"query": text, "limit": {"type": "integer", "default": 5}}, "required": ["query"]},
            {"name": "save", "parameters": {"content": text, "tags": text}, "required": ["content"]},
        ]

    def call(self, tool: str, arguments: dict, now: str) -> str:
        """The answer of a tool as JSON."""
        if tool == "recall":
            rows = self.search(arguments.get("query", ""), int(arguments.get("limit", 5))).collect()
            return json.dumps({"results": [{"id": r.id, "ts": r.ts, "tags": r.tags, "content": r.content} for r in rows]}, ensure_ascii=False)
        if tool == "save":
            row = self.spark.createDataFrame([(1, arguments.get("content", ""), arguments.get("tags") or "对话记录")], "place bigint, content string, tag string")
            verdict = self.write(row, now).first()
            return json.dumps({"status": verdict.verdict, "id": verdict.id}, ensure_ascii=False)
        return json.dumps({"error": f"no such tool: {tool}"}, ensure_ascii=False)

