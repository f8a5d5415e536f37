"""How close two token sequences are: their longest common run, and the share that matching runs make of both.

Pairs of one query lie together, and the query's suffix automaton is built once for them: it knows every run of the query,
and a text is scanned through it once, in time with its length, however often its words occur in the query. Matching runs
are found as difflib's SequenceMatcher has them (without junk): the longest, of equal ones the first in the query, then the
first in the text; then likewise left and right of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import small_batches


class Automaton:
    """The suffix automaton of some tokens: each state is a set of runs that end at the same places."""

    def __init__(self, tokens: Sequence):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]  # first: where the state's runs end first
        last = 0
        for at, token in enumerate(tokens):
            state = self._state({}, self.size[last] + 1, at)
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.next[p][token]
                if self.size[q] == self.size[p] + 1:
                    self.link[state] = q
                else:
                    twin = self._state(dict(self.next[q]), self.size[p] + 1, self.first[q])
                    self.link[twin] = self.link[q]
                    self.link[q] = self.link[state] = twin
                    while p >= 0 and self.next[p].get(token) == q:
                        self.next[p][token] = twin
                        p = self.link[p]
            last = state

    def _state(self, edges: dict, size: int, first: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.first.append(first)
        self.link.append(0)
        return len(self.next) - 1

    def longest(self, text: Sequence, start: int, end: int) -> tuple[int, int, int]:
        """(size, start in the tokens, start in the text) of the longest run that text[start:end] has; of equal ones the
        first in the tokens, then in the text. Size 0 if there is none."""
        state = held = most = 0
        best = (0, 0, 0)
        edges, root = self.next, self.next[0]
        for at in range(start, end):
            token = text[at]
            while state and token not in edges[state]:
                state = self.link[state]
                held = self.size[state]
            if state:
                state, held = edges[state][token], held + 1
            elif token in root:
                state, held = root[token], 1
            else:
                continue
            if held >= most:
                i = self.first[state] - held + 1
                if held > most or i < best[1]:
                    most, best = held, (held, i, at - held + 1)
        return best


def matched(tokens: Sequence, text: Sequence, whole: Automaton | None = None) -> tuple[int, int]:
    """(size of the longest common run, tokens in all matching runs)."""
    longest = total = 0
    known = set(tokens)
    places = [j for j, t in enumerate(text) if t in known]
    # what the tokens lack can be in no run: one mark stands for all of it between two of their words
    text = [x for k, j in enumerate(places) for x in ((text[j],) if not k or places[k - 1] == j - 1 else (None, text[j]))]
    boxes = [(0, len(tokens), 0, len(text))]
    while boxes:
        a, b, c, d = boxes.pop()
        full = whole if whole is not None and (a, b) == (0, len(tokens)) else Automaton(tokens[a:b])
        size, i, j = full.longest(text, c, d)
        if not size:
            continue
        i += a
        longest, total = max(longest, size), total + size
        if a < i and c < j:
            boxes.append((a, i, c, j))
        if i + size < b and j + size < d:
            boxes.append((i + size, b, j + size, d))
    return longest, total


def closeness(pairs: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: (query_id, chunk_id). queries, texts: (id, tokens). Each pair with run, the longest common run, and ratio,
    2 * matching tokens / tokens of both (1 if both have none). Null tokens are none. Tokens are compared in whole."""
    small_batches(pairs.sparkSession)
    asked = queries.select(F.col("id").alias("query_id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("q"))
    found = texts.select(F.col("id").alias("chunk_id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("t"))
    rows = pairs.select("query_id", "chunk_id").join(found, "chunk_id").join(asked, "query_id").repartitionByRange(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "chunk_id").sortWithinPartitions("query_id").select("query_id", "chunk_id", "q", "t")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, whole = None, None
        for batch in batches:
            runs, ratios = [], []
            for k in range(batch.num_rows):
                q, t = (batch.column(c)[k].as_py() for c in ("q", "t"))
                if q != tokens:
                    tokens, whole = q, Automaton(q)
                run, total = matched(q, t, whole)
                runs.append(run)
                ratios.append(2.0 * total / (len(q) + len(t)) if q or t else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(runs, pa.int64()), pa.array(ratios, pa.float64())], names=["query_id", "chunk_id", "run", "ratio"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(measured, f"query_id {kind('query_id')}, chunk_id {kind('chunk_id')}, run long, ratio double")
