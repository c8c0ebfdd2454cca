"""Parameters of the operators; every constant of the semantics is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Heat:
    """Heat dynamics: decay per day, cap, floor of the protected, threshold of the cold."""

    spark: float = 0.3
    cap: float = 5.0
    decay: float = 0.10
    protected_decay: float = 0.02
    floor: float = 0.5
    cold: float = 0.15
    #: Days since the last spark where that time is missing or unreadable.
    unknown_days: float = 1.0
    least_change: float = 1e-6


# Tags that protect a memory from cooling below the floor.
PROTECTED_MARKERS = ("父令", "教训", "宪法", "核心")
# Fixed value: memories so tagged are never superseded.
EXEMPT_MARKER = "经验总结"
# Text that a host injects and that is no memory.
NOISE_MARKERS = (
    "Review the conversation above",
    "consider saving to memory",
    "update the skill library",
    "[System note:",
    "Your previous turn was interrupted",
    "User correction",
    "IMPORTANT: Background process",
    "Watch patterns disabled",
    "system_reminder",
    "Be ACTIVE — most",
)
# Words of negation, longer ones first, as they stand without blanks (own choice).
NEGATIONS = ("没有", "不再", "不是", "不", "没", "never", "not")
# Words that are no concepts.
STOP_WORDS = ("怎么", "怎样", "如何", "什么", "为什么", "为啥", "哪个", "是不是", "应该", "可以", "就是", "用来", "驱动", "今天", "天气", "很好", "一片")
# Tags of a turn by the first group one of whose words the user said.
FIRST_TURN_TAG, DEFAULT_TURN_TAG = "对话开始", "对话记录"
TURN_TAGS = (
    ("记忆·对话", ("记忆", "记得", "忘了", "记住")),
    ("认知·对话", ("循环", "认知", "感知")),
    ("技术·对话", ("修", "改", "测试", "代码")),
    ("父令·对话", ("父亲说", "父令", "父授")),
)


@dataclass(frozen=True)
class Write:
    """Gates of the write chain."""

    speakers: tuple[str, str] = ("用户：", "助手：")
    least_length: int = 5
    least_dedup_length: int = 12
    dedup_window: int = 30
    #: Overlap from which a recent memory makes a new one a duplicate (own choice: above superseding).
    duplicate: float = 0.95
    supersede_window: int = 10
    supersede: float = 0.85
    turn_cut: int = 300
    noise: tuple[str, ...] = field(default=NOISE_MARKERS)


@dataclass(frozen=True)
class Selector:
    """Lexical option selector."""

    k1: float = 1.5
    b: float = 0.75
    cap: float = 40.0
    scale: float = 20.0
    least_confidence: float = 0.05
    least_margin: float = 0.03
    sweep: tuple[float, ...] = (0.0, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)


@dataclass(frozen=True)
class Training:
    epochs: int = 30
    rate: float = 0.2
    l2: float = 1e-3
    seed: int = 7
    least_gain: float = 0.08
    #: The gradient sign of the published description, which climbs the loss; off by default.
    ascend: bool = False


@dataclass(frozen=True)
class Walk:
    """Graph operators."""

    hits: int = 5
    whole_title: float = 0.8
    title_word: float = 0.5
    depth: int = 2
    nodes: int = 8
    results: int = 5
    per_keyword: int = 3
    line: int = 150


# Tools of a journal that are no decision.
DROPPED_TOOLS = ("_empty", "_brain_down", "finish")
