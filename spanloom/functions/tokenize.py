"""Tokenizers of text search."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HAN = r"\x{4e00}-\x{9fff}"
RUNS = rf"([{_HAN}]+|[\p{{L}}\p{{N}}&&[^{_HAN}]]+)"


def bigrams(text: Column) -> Column:
    """Runs of Han characters as overlapping pairs (one character stays), other alphanumeric runs in lower case."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), F.lit(1))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(rf"^[{_HAN}]"), pairs).otherwise(F.array(run))

    # Texts without a Han character, as a whole, need no look at each run.
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[{_HAN}]"), F.flatten(F.transform(runs, cut))).otherwise(runs)


class Dictionary:
    """Words with frequencies; ``cut`` takes the segmentation of greatest probability, unknown characters count once."""

    def __init__(self, words: dict[str, int]):
        self.words = {w: max(1, f) for w, f in words.items() if w}
        self.total = max(1, sum(self.words.values()))
        self.longest = max(map(len, self.words), default=1)

    @classmethod
    def parse(cls, text: str) -> Dictionary:
        """Lines of ``word frequency [part of speech]``; a missing or odd frequency counts 1; later lines win."""
        words = {}
        for line in text.splitlines():
            parts = line.split()
            if parts:
                words[parts[0]] = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 1
        return cls(words)

    def extended(self, words: dict[str, int]) -> Dictionary:
        return Dictionary({**self.words, **words})

    def _han(self, run: str) -> Iterator[str]:
        n, log_total = len(run), math.log(self.total)
        best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            choices = [(math.log(self.words.get(run[i:j], 1)) - log_total + best[j][0], j) for j in range(i + 1, min(n, i + self.longest) + 1) if j == i + 1 or run[i:j] in self.words]
            best[i] = max(choices)
        i = 0
        while i < n:
            yield run[i : best[i][1]]
            i = best[i][1]

    def cut(self, text: str | None) -> list[str]:
        out: list[str] = []
        for run in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", (text or "").lower()):
            if "一" <= run[0] <= "鿿":
                out += self._han(run)
            else:
                out.append(run)
        return out


def dictionary_tokenizer(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A tokenizer for columns; Arrow batches, the dictionary travels with the function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(dictionary.cut)

    return cut
