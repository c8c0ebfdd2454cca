"""Small made-up memories with copies, edits and traps, and the plain rules to hold results against."""

import random

from tidepool.llm.canonical import transducer
from tidepool.llm.sketch import MIN_CORE, likeness_of

SCHEMA = "id bigint, owner string, content string, tags string, created_at string, a string, b bigint, key string, text string"
WORDS = ["river", "lantern", "编译器", "缓存目录", "window", "harbor", "备用清单", "garden", "paper", "试验台账", "copper", "market", "月度报表", "silver", "engine", "planet", "花房温控", "violet"]


def sentence(rnd: random.Random, n: int = 12) -> str:
    return "，".join(f"{rnd.choice(WORDS)} {rnd.choice(WORDS)}{rnd.randrange(1000)}" for _ in range(n))


def memories(seed: int = 1, n: int = 220) -> list[tuple]:
    rnd, rows, texts = random.Random(seed), [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.45:
            base = rnd.choice(texts)
            text = [base, base.upper(), base.replace("，", "。 "), base + " 补充", base.replace("river", "canal", 1), "，".join(reversed(base.split("，"))), base[: len(base) * 3 // 4]][rnd.randrange(7)]
        else:
            text = sentence(rnd, rnd.choice([3, 8, 12]))
        texts.append(text)
        owner = "hot" if rnd.random() < 0.5 else rnd.choice(["p", "q"])
        time = f"2026-01-{1 + i * 27 // n:02d} 0{i % 10}:00:00"
        rows.append((i, owner, text, rnd.choice(['["x", "y"]', "Y;x", "x", None, ""]), rnd.choice([time, time.replace(" ", "T") + ".250", time.replace("-", "/")]), "a", 1, "k", "t"))
    odd = [None, "", "   ", "short", "ok。", "x" * 11, "é" * 30_000 + sentence(rnd)]
    rows += [(n + i, "hot", t, "z", "2026-01-20 00:00:00", None, None, None, None) for i, t in enumerate(odd * 2)]
    rows += [(n + 50, None, texts[0], "x", "2026-01-20 00:00:00", *[None] * 4), (n + 51, "hot", texts[0], "x", None, *[None] * 4), (n + 52, "hot", texts[0], "x", "no time", *[None] * 4)]
    rows += [(None, "hot", texts[0], "x", "2026-01-20 00:00:00", *[None] * 4)] * 2
    return rows + rows[:3]


def cores(rows: list[tuple]) -> dict[int, tuple[str, str]]:
    """Owner and core of each row that counts."""
    core = transducer().core
    return {r[0]: (r[1], k) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(k := core(r[2])) >= MIN_CORE}


def linked(rows: list[tuple], least: float = 0.6) -> set[tuple[int, int]]:
    known = cores(rows)
    return {(i, j) for i in known for j in known if i < j and known[i][0] == known[j][0] and (known[i][1] == known[j][1] or likeness_of(known[i][1], known[j][1]) >= least)}
