"""Command line of the engine: python -m tidepool.cli --memories PATH [--graph PATH] COMMAND [TEXT]."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidepool.api import Engine
from tidepool.sources import stores

COMMANDS = ("write", "recall", "light", "associate", "premonition", "portrait", "search", "decay", "rhythm", "compress", "weave", "themes", "overview", "health", "state", "identity", "parameters", "wake", "warmup", "scorecard", "preview", "sleep")


def run(engine: Engine, command: str, text: str, tags: str, now: str) -> str:
    spark = engine.spark
    show = lambda df: "\n".join(json.dumps(r.asDict(), ensure_ascii=False, default=str) for r in df.toLocalIterator())
    actions = {
        "write": lambda: engine.call("save", {"content": text, "tags": tags}, now),
        "recall": lambda: json.dumps(engine.recall(text), ensure_ascii=False),
        "light": lambda: show(engine.light(text)),
        "associate": lambda: show(engine.associate(text)),
        "premonition": lambda: show(engine.premonition()),
        "portrait": lambda: json.dumps(engine.portrait(), ensure_ascii=False),
        "search": lambda: show(engine.search(text)),
        "decay": lambda: show(engine.decay(now)),
        "rhythm": lambda: show(engine.rhythm()),
        "compress": lambda: show(engine.compress(now)),
        "weave": lambda: show(engine.weave()),
        "themes": lambda: show(engine.themes()),
        "overview": lambda: show(engine.overview()),
        "health": lambda: json.dumps(engine.health()),
        "state": lambda: show(engine.state()),
        "identity": lambda: show(engine.identity_line(text)),
        "sleep": lambda: json.dumps(engine.sleep(now)),
        "parameters": lambda: json.dumps(engine.parameters(), ensure_ascii=False, default=str),
        "warmup": lambda: show(engine.warm_up(text)),
        "scorecard": lambda: show(engine.scorecard()),
        "preview": lambda: show(engine.previews()),
        "wake": lambda: engine.system_block(text),
    }
    assert spark is not None and set(actions) == set(COMMANDS)
    return actions[command]()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    places = stores.Places.from_environment()
    parser.add_argument("--memories", default=places.memories)
    parser.add_argument("--graph", default=places.graph)
    parser.add_argument("--owner", default="me")
    parser.add_argument("--tags", default="对话记录")
    parser.add_argument("--now", default=datetime.now().strftime("%Y-%m-%d %H:%M:%S"))
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("text", nargs="?", default="")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidepool").getOrCreate()
    graph: tuple[DataFrame | None, DataFrame | None] = stores.read_graph(spark, a.graph) if a.graph else (None, None)
    print(run(Engine(spark, a.memories, *graph, owner=a.owner), a.command, a.text, a.tags, a.now))


if __name__ == "__main__":
    main()
