"""Main text of web pages by minimum-cut labelling of their blocks.

A logistic classifier looks at each block by itself: its length, sentences, share of links, element, and whether it stands
in something that tag, role or name mark as furniture. Its log-odds are the terminal capacities. What a block is part of
comes in by the graph: smoothness edges join blocks that follow each other (the closer in the tree, the stronger), blocks of
one parent, and each block with a node for the main part that it is in, or, outside of the page's main part, with a node for
the rest of the page. The minimum cut labels all blocks of a page at once.

The classifier is fitted on made-up pages (html_samples) when it is first used; the edges' weights were chosen on others of
them (see tuned in the tests).
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, text_or_empty
from textloom.llm.html_blocks import Block, Element, Page, distance, parse
from textloom.llm.html_samples import label, pages
from textloom.llm.mincut import minimum_cut

CHUNK_BYTES = 4 << 20
#: Pages that the classifier is fitted on, and their seed.
FITTED, SEED = 400, 1
FEATURES = ("one", "length", "sentences", "links", "paragraph", "title", "heading", "item", "cell", "furniture", "header", "bad_name")
_SENTENCE = re.compile(r"[.!?…。？！](?:[\"'”’)]*)(?:\s|$)")
_KINDS = {t: i for i, tags in enumerate((("p", "blockquote", "pre", "figcaption"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("td", "th")), 4) for t in tags}


@dataclass(frozen=True)
class Edges:
    """Weights of the smoothness edges and of the two nodes that blocks are joined with."""

    following: float = 2.0
    fades: float = 0.8  # for each step between two blocks in the tree
    sibling: float = 0.1
    part: float = 2.0  # a block and the main part that it is in
    part_leans: float = 8.0  # to main text
    rest: float = 2.0  # a block and the rest of the page
    rest_leans: float = 8.0  # to furniture


def features(b: Block) -> list[float]:
    n, e = len(b.text), b.element
    x = [1.0, min(3.0, math.log1p(n / 40)), float(min(2, len(_SENTENCE.findall(b.text)))), b.link_chars / n, 0.0, 0.0, 0.0, 0.0, 0.0, float(e.furniture), float(e.header), float(e.bad)]
    if e.tag in _KINDS:
        x[_KINDS[e.tag]] = 1.0
    return x


def fitted(samples: list[str], ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on the blocks of labelled pages, by Newton's method."""
    found = [b for page in samples for b in parse(page).blocks]
    x, y = np.array([features(b) for b in found]), np.array([label(b.text) for b in found], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


@functools.cache
def classifier() -> tuple[float, ...]:
    return tuple(fitted(pages(FITTED, SEED)).tolist())


def _part_of(e: Element) -> Element | None:
    """The innermost main part that an element is in."""
    while e is not None and not e.chief:
        e = e.parent
    return e


def labels(page: Page, weights: tuple[float, ...], edges: Edges = Edges(), cut: Callable = minimum_cut) -> tuple[list[bool], list[bool]]:
    """Of each block, whether it is main text: by the cut, and by its own cost alone."""
    costs = [sum(w * x for w, x in zip(weights, features(b))) for b in page.blocks]
    links: dict[tuple[int, int], float] = {}
    nodes: dict[int, int] = {}
    leans: list[float] = []
    inside = {id(page.main)} if page.main else set()
    last: dict[int, int] = {}
    part_of: dict[int, Element | None] = {}

    def join(a: int, b: int, weight: float) -> None:
        if weight > 0:
            links[a, b] = links.get((a, b), 0.0) + weight

    def node(key: int, lean: float) -> int:
        if key not in nodes:
            nodes[key] = len(page.blocks) + len(nodes)
            leans.append(lean)
        return nodes[key]

    for i, b in enumerate(page.blocks):
        e = b.element
        if i:
            join(i - 1, i, edges.following * edges.fades ** distance(page.blocks[i - 1].element, e, 30))
        if id(e.parent) in last:
            join(last[id(e.parent)], i, edges.sibling)
        last[id(e.parent)] = i
        if e.article:
            if id(e) not in part_of:
                part_of[id(e)] = _part_of(e)
            part = part_of[id(e)]
            join(i, node(id(part), edges.part_leans), edges.part)
            if id(part) not in inside and page.main is not None and _within(part, page.main):
                inside.add(id(part))
        if page.main is not None and not (e.article and id(part_of[id(e)]) in inside):
            join(i, node(0, -edges.rest_leans), edges.rest)
    every = [*costs, *leans]
    sides = cut([max(0.0, c) for c in every], [max(0.0, -c) for c in every], [(a, b, w) for (a, b), w in links.items()])
    return sides[: len(costs)], [c > 0 for c in costs]


def _within(e: Element | None, of: Element) -> bool:
    while e is not None and e.depth > of.depth:
        e = e.parent
    return e is of


def main_text(page: str, weights: tuple[float, ...] | None = None) -> str:
    parsed = parse(page)
    chosen, _ = labels(parsed, weights or classifier())
    return "\n\n".join(b.text for b, good in zip(parsed.blocks, chosen) if good)


def errors(samples: list[str], weights: tuple[float, ...], edges: Edges = Edges()) -> tuple[int, int, int, int]:
    """Of labelled pages: blocks, those that the cut labels otherwise than their own cost, and wrong ones by the cut and by
    the costs alone."""
    n = changed = by_cut = by_cost = 0
    for text in samples:
        page = parse(text)
        for b, x, y in zip(page.blocks, *labels(page, weights, edges)):
            right = label(b.text)
            n, changed, by_cut, by_cost = n + 1, changed + (x != y), by_cut + (x != right), by_cost + (y != right)
    return n, changed, by_cut, by_cost


def tuned(samples: list[str], weights: tuple[float, ...], start: Edges = Edges()) -> Edges:
    """The edges' weights, one after the other, that leave the fewest wrong labels on the samples."""
    grid = {"following": (0.0, 0.5, 1.0, 1.5, 2.0, 3.0), "fades": (0.4, 0.6, 0.8), "sibling": (0.0, 0.25, 0.5, 1.0, 1.5), "part": (0.0, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0), "rest": (0.0, 0.5, 1.0, 1.5, 2.0)}
    best = start
    for _ in range(2):
        for name, values in grid.items():
            best = min((replace(best, **{name: v}) for v in values), key=lambda e: errors(samples, weights, e)[2])
    return best


def extract(html_pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """html_pages without html_col and with a column more: the main text of the whole page, blocks joined by an empty line,
    "" where there is none. A null page counts as empty. No shuffle; other columns pass through untouched, but one of
    that name is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept, weights = [c for c in html_pages.columns if c not in (html_col, name)], classifier()
    rows = html_pages.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(html_col).alias(name))
    schema = StructType([*(html_pages.schema[c] for c in kept), StructField(name, StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, name, CHUNK_BYTES):
            texts = pa.array([main_text(t, weights) for t in batch.columns[-1].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)

    return rows.mapInArrow(extracted, schema)
