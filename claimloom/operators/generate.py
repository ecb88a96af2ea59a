"""Answers of a language model to prompts, by a client that can be exchanged.

A client has ask(prompt) and ask_batch(prompts). It is made once in each task, from its
settings; the number of partitions is the number of prompts in flight. If a batch fails its
prompts are asked one by one, and one that fails has an empty answer and an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import values as V
from .lineage import cut, small


def _setting(given, name: str, default):
    """What is given, zero included; else the environment's; else the default."""
    if given is not None:
        return given
    return type(default)(os.environ[name]) if os.environ.get(name) else default


@dataclass
class ChatClient:
    """A client of the chat completions protocol."""

    base_url: str | None = None
    model: str | None = None
    api_key: str | None = None
    max_tokens: int | None = None
    temperature: float | None = None
    timeout: int | None = None
    used: dict = field(default_factory=lambda: {"prompt_tokens": 0, "completion_tokens": 0})

    def __post_init__(self):
        self.base_url = _setting(self.base_url, "CHAT_BASE_URL", "http://localhost:8000")
        self.model = _setting(self.model, "CHAT_MODEL", "default")
        self.api_key = _setting(self.api_key, "CHAT_API_KEY", "")
        self.max_tokens = _setting(self.max_tokens, "CHAT_MAX_TOKENS", 256)
        self.temperature = _setting(self.temperature, "CHAT_TEMPERATURE", 0.7)
        self.timeout = _setting(self.timeout, "CHAT_TIMEOUT", 120)

    def ask(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + "/v1/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            got = json.loads(answer.read())
        for k in self.used:
            self.used[k] += int((got.get("usage") or {}).get(k) or 0)
        choices = got.get("choices") or []
        return ((choices[0].get("message") or {}).get("content") or "").strip() if choices else ""

    def ask_batch(self, prompts: list[str]) -> list[str]:
        return [self.ask(p) for p in prompts]


@dataclass
class StubClient:
    """Answers made from a hash of the prompt, with lines that parsers must drop."""

    words: tuple = ("rain", "soil", "yield", "price", "trade", "water", "heat", "crop", "labor", "credit")

    def ask(self, prompt: str) -> str:
        h = hashlib.sha256(prompt.encode()).digest()
        w = [self.words[b % len(self.words)] for b in h]
        if "sentences" in prompt:
            return f"Note: an aside here. {w[0].title()} {w[1]} increases {w[2]} {w[3]}. {w[4].title()} supply reduces {w[5]} demand over time. Nothing of cause is said."
        if "questions" in prompt:
            return f"- How does {w[0]} {w[1]} affect {w[2]} here?\n- What reduces {w[3]} and {w[4]} losses?\nnote: skip\n- Which {w[5]} causes {w[6]} change?"
        return f"1. {w[0]} {w[1]}\n- {w[2]} {w[3]} {w[4]}\nnote: skip this\n2. {w[0].upper()} {w[1]}\n* {w[5]} and {w[6]}"

    def ask_batch(self, prompts: list[str]) -> list[str]:
        return [self.ask(p) for p in prompts]


def answered(prompts: DataFrame, client: Callable, batch: int = 16, column: str = "prompt") -> DataFrame:
    """prompts with raw, error, and the tokens that a client which counts them has used: those of a
    batch of prompts at its first one. client: makes a client; it is sent to the tasks."""
    shape = ", ".join(f"{n} {t}" for n, t in prompts.dtypes) + ", raw string, error string, prompt_tokens long, completion_tokens long"

    def run(batches):
        c = client()
        for b in batches:
            raws, errors, used = [], [], {"prompt_tokens": [], "completion_tokens": []}
            asked = b[column].tolist()
            for i in range(0, len(asked), batch):
                part = asked[i : i + batch]
                before = dict(getattr(c, "used", None) or {})
                try:
                    got = list(c.ask_batch(part))[: len(part)]
                    got, bad = got + [""] * (len(part) - len(got)), [None] * len(part)
                except Exception:  # one prompt must not cost the others their answers
                    got, bad = [], []
                    for p in part:
                        try:
                            got.append(c.ask(p))
                            bad.append(None)
                        except Exception as e:
                            got.append("")
                            bad.append(str(e)[:500])
                raws += got
                errors += bad
                for k, v in used.items():
                    v += [int((getattr(c, "used", None) or {}).get(k, 0)) - int(before.get(k, 0))] + [0] * (len(part) - 1)
            yield b.assign(raw=pd.Series(raws, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object), **{k: pd.Series(v, index=b.index, dtype="int64") for k, v in used.items()})

    return prompts.mapInPandas(run, shape)


def usage_log(answers: DataFrame, stage: str) -> DataFrame:
    """One row for the usage log of a stage: how many prompts, failed ones, and tokens."""
    return answers.agg(
        F.lit(stage).alias("stage"), F.count("*").alias("prompts"), F.count("error").alias("failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.current_timestamp().alias("at"),
    )


def max_tokens(n: int, floor: int = 48) -> int:
    """Tokens allowed for n statements."""
    return max(floor, max(96, 96 * n))


def expand_topics(roots: DataFrame, client: Callable | None, depth: int = V.TOPIC_DEPTH, most: int = V.MAX_TOPICS, wave: int | None = None) -> DataFrame:
    """roots (seq, topic) to (topic, parent, depth, seq). Topics of a level are expanded together;
    new ones are admitted in order, up to `most` in all. All roots are admitted; without a client,
    or with as many roots as that, they are all there is."""
    first = roots.groupBy("topic").agg(F.min("seq").alias("seq"))
    known = cut(first.select("topic", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("seq").cast("long").alias("seq")), "topics")
    level, total = known, known.count()
    for step in range(1, depth + 1):
        if client is None or total >= most or small(level, 1):
            break
        raw = answered(level.select("topic", "seq", X.subtopic_prompt("topic").alias("prompt")), client, wave or 8)
        found = raw.select(F.col("topic").alias("parent"), F.col("seq").alias("ps"), F.posexplode(X.subtopics("raw")).alias("pos", "topic"))
        new = found.groupBy("topic").agg(F.min(F.struct("ps", "pos", "parent")).alias("f")).join(known.select("topic"), "topic", "left_anti")
        admitted = new.orderBy("f", "topic").limit(most - total)
        base = (known.agg(F.max("seq")).first()[0] or 0) + 1
        at = F.row_number().over(Window.orderBy("f", "topic")) - 1  # at most `most` rows
        level = cut(admitted.select("topic", F.col("f.parent").alias("parent"), F.lit(step).alias("depth"), (at + base).cast("long").alias("seq")), "topics")
        total += level.count()
        known = cut(known.unionByName(level), "topics")
    return known
