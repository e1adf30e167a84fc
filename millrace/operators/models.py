"""Operators around a language model, behind one seam: a function from prompts to answers.

Everything but that function is deterministic: batching, budgets, halving, retries, parsing, and what is
done with the answers. Tests and the default use stubs; a real client is made inside the executors.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

Ask = Callable[[str], str]
_TOO_LARGE = re.compile(r"413|context.{0,10}length|too (long|large)|maximum.{0,20}tokens|truncat|timed? ?out|incomplete|unterminated", re.I)


class ModelError(Exception):
    """A failed call; ``status`` as HTTP has it, ``retry_after`` in seconds where the service said so."""

    def __init__(self, said: str = "", status: int | None = None, retry_after: float | None = None) -> None:
        super().__init__(said)
        self.status, self.retry_after = status, retry_after


class Refusal(ModelError):
    """No answer was given; asking again is pointless."""


def is_size_failure(e: Exception) -> bool:
    """Whether a shorter text may do: too large, cut off, unreadable or out of time."""
    if isinstance(e, Refusal):
        return False
    return isinstance(e, (json.JSONDecodeError, TimeoutError)) or getattr(e, "status", None) == 413 or bool(_TOO_LARGE.search(str(e)))


def is_model_failure(e: Exception) -> bool:
    return isinstance(e, (ModelError, TimeoutError, ConnectionError, json.JSONDecodeError))


def with_retries(ask: Ask, retries: int = 2, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> Ask:
    """Ask again after rate limits, lost connections and server errors: doubling waits, half as much more or
    less by chance, at most ``most``; a service's own wait counts up to that."""
    rng = random.Random(seed)

    def run(prompt: str) -> str:
        for n in range(retries + 1):
            try:
                return ask(prompt)
            except (ModelError, ConnectionError) as e:
                status = getattr(e, "status", None)
                passing = isinstance(e, ConnectionError) or status == 429 or (status or 0) >= 500
                if isinstance(e, Refusal) or not passing or n == retries:
                    raise
                wait = getattr(e, "retry_after", None)
                sleep(min(most, wait if wait is not None else base * 2**n * rng.uniform(0.5, 1.5)))
        raise AssertionError

    return run


def halve(text: str) -> tuple[str, str]:
    """Two parts, cut at the blank line, else the line break, nearest the middle (the earlier of two), else in the middle."""
    middle = len(text) // 2
    for mark in ("\n\n", "\n"):
        cuts = [m.end() for m in re.finditer(re.escape(mark), text) if 0 < m.end() < len(text)]
        if cuts:
            at = min(cuts, key=lambda c: (abs(c - middle), c))
            return text[:at], text[at:]
    return text[:middle], text[middle:]


def ask_halving(ask: Ask, text: str, depth: int = 3, least: int = 1000) -> list[str]:
    """The answers for a text, halved as long as it is the size that fails."""
    try:
        return [ask(text)]
    except Exception as e:
        if depth == 0 or len(text) < least or not is_size_failure(e):
            raise
        return [x for part in halve(text) for x in ask_halving(ask, part, depth - 1, least)]


def pack_texts(texts: list[str], count: Callable[[str], int], most: int) -> list[list[str]]:
    """In order, greedily: a new pack begins where the next text would overfill one that isn't empty."""
    packs: list[list[str]] = []
    total = 0
    for t in texts:
        n = count(t)
        if not packs or total + n > most:
            packs.append([])
            total = 0
        packs[-1].append(t)
        total += n
    return packs


def summarise(ask: Ask, text: str, count: Callable[[str], int], least: int = 2000, most: int = 100_000, depth: int = 5) -> str:
    """Short texts stay as they are, those up to ``most`` tokens take one call, longer ones are cut into parts
    whose summaries are packed and summarised again; after ``depth`` levels the rest is cut off."""
    if count(text) <= least:
        return text
    if count(text) <= most:
        return ask(text)
    if depth == 0:
        while count(text) > most:
            text = text[: len(text) * most // max(count(text), most + 1)]
        return ask(text)
    a, b = halve(text)
    parts = [summarise(ask, p, count, least, most, depth - 1) for p in (a, b)]
    packs = pack_texts(parts, count, most)
    joined = "\n\n".join("\n\n".join(p) for p in packs)
    return summarise(ask, joined, count, least, most, depth - 1)


def answers(ask_maker: Callable[[], Ask], prompts: Column) -> Column:
    """A column of answers; the client is made once a batch, inside the executor. Failures become null."""

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        ask = ask_maker()

        def one(t):
            if t is None:
                return None
            try:
                return ask(t)
            except Exception as e:
                if is_model_failure(e):
                    return None
                raise

        return texts.map(one)

    return run(prompts)


def extract_mentions(splits: DataFrame, ask_maker: Callable[[], Ask], payload: str, least_words: int = 1) -> DataFrame:
    """``doc_id, split_sequence, place, payload struct``: a JSON list is asked for every split that isn't blank."""
    worth = splits.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words).where(F.trim("text") != "")
    found = worth.withColumn("found", F.from_json(answers(ask_maker, F.col("text")), f"array<{payload}>"))
    return found.select("doc_id", "split_sequence", F.posexplode("found").alias("place", "payload"))


def judge_headings(headings: DataFrame, ask_maker: Callable[[], Ask], batch: int = 50) -> DataFrame:
    """Adds ``judgment`` (title, h1 to h6, none), asked for batches of a document's headings; a batch whose
    answer fails or has another length leaves its headings without one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    numbered = headings.withColumn("__b", F.floor((F.row_number().over(order) - 1) / batch))
    rows = numbered.groupBy("doc_id", "__b").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("hs"))
    asked = rows.withColumn("said", F.from_json(answers(ask_maker, F.to_json(F.transform("hs", lambda h: h["text"]))), "array<string>"))
    fair = asked.where(F.size("said") == F.size("hs")).select("doc_id", F.explode(F.arrays_zip("hs", "said")).alias("z"))
    judged = fair.select("doc_id", F.col("z.hs.pos").alias("pos"), F.col("z.said").alias("judgment")).where(F.col("judgment").isin("title", "none", *(f"h{i}" for i in range(1, 7))))
    return headings.join(judged, ["doc_id", "pos"], "left")


def describe_images(images: DataFrame, ask_maker: Callable[[], Ask]) -> DataFrame:
    """Fills ``text_representation`` where it is missing, from answers ``{"summary", "decorative"}``; decorative
    images and failures keep null."""
    said = F.from_json(answers(ask_maker, F.when(F.col("text_representation").isNull(), F.col("context"))), "summary string, decorative boolean")
    return images.withColumn("__s", said).withColumn("text_representation", F.coalesce("text_representation", F.when(~F.coalesce("__s.decorative", F.lit(False)), F.col("__s.summary")))).drop("__s")
