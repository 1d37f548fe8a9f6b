"""Model clients: a small protocol, a call that runs them in Arrow batches, and an offline client."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class CallPolicy:
    """How a partition talks to its client: texts per call, tries, and the pause before each retry
    (doubled every time)."""

    batch: int = 50
    tries: int = 3
    pause: float = 1.0


def _ask(client: ModelClient, policy: CallPolicy, method: str, texts: list[str]) -> tuple[list, list]:
    answers, errors = [], []
    for s in range(0, len(texts), policy.batch):
        part = texts[s : s + policy.batch]
        for attempt in range(policy.tries):
            try:
                answers += getattr(client, method)(part)
                errors += [None] * len(part)
                break
            except Exception as e:
                if attempt + 1 == policy.tries:
                    answers += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"[:500]] * len(part)
                else:
                    time.sleep(policy.pause * 2**attempt)
    return answers, errors


def completion(prompt: Column, factory: Callable[[], ModelClient], policy: CallPolicy = CallPolicy()) -> Column:
    """``struct<text, error>`` per prompt. One client per Python worker; failures are rows with an
    error, not exceptions. Null prompts are not sent. Store the result before using it twice: Spark
    may evaluate it again, and a model need not answer alike."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            text, error = pd.Series([None] * len(b), dtype=object), pd.Series([None] * len(b), dtype=object)
            at = [k for k, p in enumerate(b) if isinstance(p, str)]
            got, bad = _ask(client, policy, "complete", [b.iloc[k] for k in at])
            for k, g, e in zip(at, got, bad):
                text[k], error[k] = g, e
            yield pd.DataFrame({"text": text, "error": error})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "text string, error string")(prompt)


def embedding(text: Column, factory: Callable[[], ModelClient], policy: CallPolicy = CallPolicy()) -> Column:
    """Vector per text; null for null texts and failed calls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for b in batches:
            out = pd.Series([None] * len(b), dtype=object)
            at = [k for k, p in enumerate(b) if isinstance(p, str)]
            got, _ = _ask(client, policy, "embed", [b.iloc[k] for k in at])
            for k, g in zip(at, got):
                out[k] = g
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def reuse_embeddings(df: DataFrame, text: str, vector: str, factory: Callable[[], ModelClient]) -> DataFrame:
    """Fill only missing vectors; rows that have one are not sent."""
    have = df.where(F.col(vector).isNotNull())
    fresh = df.where(F.col(vector).isNull()).withColumn(vector, embedding(F.col(text), factory))
    return have.withColumn(vector, F.col(vector).cast("array<double>")).unionByName(fresh)


@dataclass(frozen=True)
class HttpModel:
    """Client of a service with the widespread JSON interface of ``/chat/completions`` and
    ``/embeddings``. ``key_from`` names the environment variable, on the workers, that holds the
    key. A request that ends in an error raises; ``CallPolicy`` decides whether it is tried again.
    """

    url: str
    chat_model: str = ""
    embedding_model: str = ""
    timeout: float = 180.0
    temperature: float = 0.0
    key_from: str | None = None

    def _post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"}
        if self.key_from:
            head["Authorization"] = f"Bearer {os.environ[self.key_from]}"
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def complete(self, prompts: list[str]) -> list[str]:
        ask = lambda p: {"model": self.chat_model, "temperature": self.temperature, "messages": [{"role": "user", "content": p}]}
        return [self._post("chat/completions", ask(p))["choices"][0]["message"]["content"] for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = sorted(self._post("embeddings", {"model": self.embedding_model, "input": texts})["data"], key=lambda d: d["index"])
        if len(found) != len(texts):
            raise ValueError("the service returned another number of vectors")
        return [d["embedding"] for d in found]


class OfflineModel:
    """Deterministic stand-in for chat and embedding services.

    Reads the fields of our own prompts (``KEY: value`` blocks) and answers in the JSON that the
    stage expects. Embeddings are signed feature hashes of words and letter triples.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", t.lower()):
                for f in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                    h = zlib.crc32(f.encode())
                    v[h % self.dimension] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        fields = {k: v.strip() for k, v in re.findall(r"^([A-Z_]+): (.*?)(?=^[A-Z_]+: |\Z)", prompt, re.M | re.S)}
        task = fields.get("TASK", "echo").split("\n")[0].strip().lower()
        return getattr(self, "_" + task, self._echo)(fields)

    @staticmethod
    def _words(text: str) -> list[str]:
        return list(dict.fromkeys(w for w in re.findall(r"\w+", text.lower()) if len(w) > 4))

    @staticmethod
    def _sentences(text: str) -> list[str]:
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.strip()) > 20]

    def _echo(self, f: dict) -> str:
        return json.dumps({"text": f.get("TEXT", "")})

    def _questions(self, f: dict) -> str:
        kinds = [f.get("KIND") or "factual", "explanatory", "procedural"]
        words = self._words(f.get("TEXT", ""))
        items = [
            {"question": f"What does the record say about {w}?", "follow_up_q": f"And how does {w} change over time?", "question_type": kinds[k % 3], "difficulty": ("simple", "moderate", "complex")[k % 3]}
            for k, w in enumerate(words[: int(f.get("MOST", "3").split()[0])])
        ]
        return "```json\n" + json.dumps(items) + "\n```"

    def _filter(self, f: dict) -> str:
        return json.dumps([q for q in f.get("QUESTIONS", "").split("\n") if len(q) > 15])

    def _properties(self, f: dict) -> str:
        words = self._words(f.get("TEXT", ""))
        return json.dumps({"entities": [w.title() for w in words[:6]], "keyphrases": words[6:14], "topics": words[:2]})

    def _bridge(self, f: dict) -> str:
        shared = [w for w in self._words(f.get("A", "")) if w in set(self._words(f.get("B", "")))][:5]
        return json.dumps({"bridge_concepts": shared, "connection_type": "shared_concept" if shared else "none"})

    def _multihop(self, f: dict) -> str:
        words = [w for w in f.get("CONCEPTS", "").split(", ") if w]
        return json.dumps([{"question": f"How does {w} link both records?", "follow_up_q": f"What follows from {w} in both?", "difficulty": "complex", "reasoning_type": "bridge"} for w in words[: int(f.get("MOST", "3").split()[0])]])

    def _answer(self, f: dict) -> str:
        asked = set(self._words(f.get("QUESTION", "")))
        best = sorted(self._sentences(f.get("CONTEXT", "")), key=lambda s: (-len(asked & set(self._words(s))), s))
        return json.dumps({"answer": best[0] if best else "", "follow_up_a": best[1] if len(best) > 1 else ""})

    def _score(self, f: dict) -> str:
        a, c = set(self._words(f.get("ANSWER", ""))), set(self._words(f.get("CONTEXT", "")))
        q = set(self._words(f.get("QUESTION", "")))
        held = len(a & c) / len(a) if a else 0.0
        near = min(1.0, 0.5 + len(a & q) / (2 * len(q))) if q else 0.5
        return json.dumps({"faithfulness": round(held, 3), "relevance": round(near, 3), "completeness": round(min(1.0, len(a) / 10), 3), "tone": 0.9, "follow_up_quality": 0.8, "multi_hop_validity": 0.7, "reasoning": "overlap of words"})

    def _claims(self, f: dict) -> str:
        return json.dumps({"claims": self._sentences(f.get("ANSWER", ""))})

    def _verify(self, f: dict) -> str:
        context = set(self._words(f.get("CONTEXT", "")))
        said = [c for c in f.get("CLAIMS", "").split("\n") if c]
        return json.dumps({"verdicts": ["supported" if set(self._words(c)) <= context else "unsupported" for c in said]})

    def _precision(self, f: dict) -> str:
        asked = set(self._words(f.get("QUESTION", "")))
        return json.dumps({"relevant": [bool(asked & set(self._words(p))) for p in f.get("CONTEXT", "").split("\n\n---\n\n") if p]})

    def _recall(self, f: dict) -> str:
        context = set(self._words(f.get("CONTEXT", "")))
        said = self._sentences(f.get("ANSWER", ""))
        return json.dumps({"total": len(said), "attributed": sum(1 for s in said if set(self._words(s)) <= context)})

    def _reverse(self, f: dict) -> str:
        return json.dumps({"questions": [f"What does the record say about {w}?" for w in self._words(f.get("ANSWER", ""))[:3]]})
