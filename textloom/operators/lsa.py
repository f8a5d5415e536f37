"""TF-IDF and its truncated singular value decomposition, for search by latent topics.

Texts are sparse rows over a vocabulary of bounded size. The right singular space is found by subspace iteration: each
round multiplies the rows with a basis, which only has the vocabulary's height, and with what comes out. Rows never leave
their tasks. What grows with the corpus is factored where it lies: every task reduces its rows' products to a triangle by
QR, and triangles are stacked and reduced again in a tree, whose root has the singular values. On the driver, and in
the broadcast, there is the basis alone, of MOST_BYTES at most; a larger one is an error.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lexical import row_counts, rows_in
from textloom.operators.storage import give_back, small_batches, written

#: Words of two letters, figures or more.
WORD = r"[\p{L}\p{N}_]{2,}"
MOST_BYTES = 512 << 20
#: Vocabulary entries to a row of a matrix on its way, rows of the tree that meet in a task.
HEIGHT, FAN = 2048, 16
#: Rows to a task at least, words that are counted at a time.
TASK_ROWS, WORDS = 1500, 1 << 19
_FOLDED = {chr(c): base[0] for c in range(0xC0, 0x250) if len(base := [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and base[0] != chr(c)}


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their accents."""
    return F.translate(F.lower(text), "".join(_FOLDED), "".join(_FOLDED.values()))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def terms(text: Column, stop_words: list[str]) -> Column:
    """Words that are no stop words, then pairs of neighbours among them."""
    kept = F.filter(words(text), lambda w: ~w.isin(*stop_words)) if stop_words else words(text)
    pairs = lambda k: F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.element_at(F.transform(F.array(kept), lambda k: F.concat(k, F.when(F.size(k) > 1, pairs(k)).otherwise(F.array().cast("array<string>")))), 1)


def frequencies(texts: DataFrame) -> DataFrame:
    """texts: (id, terms). (id, term, tf)."""
    return texts.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, texts: int, least: int = 2, most: float = 0.98, size: int = 30_000) -> DataFrame:
    """chosen of what frequencies() gives."""
    return chosen(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), texts, least, most, size)


def chosen(totals: DataFrame, texts: int, least: int = 2, most: float = 0.98, size: int = 30_000) -> DataFrame:
    """(term, df, cf, idf, place): terms in at least so many and at most such a share of all texts; if there are more than
    size, those that occur most, ties by term. place: from 0, by term. idf: ln((1 + texts) / (1 + df)) + 1."""
    found = totals.filter((F.col("df") >= least) & (F.col("df") <= most * texts))
    top = found.orderBy(F.desc("cf"), "term").limit(size)
    place = F.row_number().over(Window.orderBy("term")) - 1  # size rows at most
    return top.withColumn("idf", F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1).withColumn("place", place)


def rows_of(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, places, weights): (1 + ln tf) * idf, of length 1. A text without a known term has no row."""
    known = tf.join(vocab.select("term", "place", "idf"), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    held = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("x"))
    norm = F.sqrt(F.aggregate("x.w", F.lit(0.0), lambda a, w: a + w * w))
    normed = held.select("id", "x", norm.alias("norm"))  # a column: else it is summed anew for every weight
    return normed.select("id", F.col("x.place").alias("places"), F.transform("x.w", lambda w: w / F.col("norm")).alias("weights"))


def one_a_text(texts: DataFrame) -> bool:
    """Whether no id is there twice: only then may a text be counted where it lies."""
    return texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0


def _counted(batch: pa.RecordBatch, stop_words: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(first row, row after it, term, times) of some rows' words at a time, stop words left out and pairs of neighbours added."""
    sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        lists = batch.column("words").slice(start, end - start)
        row, word = rows_in(lists), lists.flatten()
        fine = ~pc.is_in(word, value_set=stop_words).to_numpy(zero_copy_only=False)
        row, word = row[fine], word.filter(pa.array(fine))
        beside = row[1:] == row[:-1]
        left, right = (w.filter(pa.array(beside)) for w in (word.slice(0, len(beside)), word.slice(1)))
        pairs = pc.binary_join_element_wise(left, right, " ")
        yield (start, *row_counts(np.append(row, row[1:][beside]), pa.concat_arrays([word, pairs])))


def totals(texts: DataFrame, stop_words: list[str]) -> DataFrame:
    """texts: (id, words), ids unique. (term, df, cf) of all terms. Texts are counted where they lie; what some of them sum
    up to is shuffled."""
    small_batches(texts.sparkSession)
    stop = pa.array(stop_words, pa.string())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, term, times in _counted(batch, stop):
                coded = term.dictionary_encode()
                code, n = coded.indices.to_numpy(), len(coded.dictionary)
                df, cf = np.bincount(code, minlength=n), np.bincount(code, times, n)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df, pa.int64()), pa.array(cf.astype(np.int64))], names=["term", "df", "cf"])
        give_back()

    return texts.select("words").mapInArrow(made, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def weighed(texts: DataFrame, vocab: DataFrame, stop_words: list[str]) -> DataFrame:
    """rows_of of texts (id, words), ids unique. The vocabulary is broadcast, and a text is weighed where it lies."""
    small_batches(texts.sparkSession)
    known = vocab.select("term", "place", "idf").toArrow().sort_by("place")  # of bounded size
    shared = texts.sparkSession.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("idf").to_numpy()))
    stop = pa.array(stop_words, pa.string())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, idf = shared.value
        for batch in batches:
            for start, row, term, times in _counted(batch, stop):
                place = pc.fill_null(pc.index_in(term, value_set=entries), -1).to_numpy(zero_copy_only=False)
                there = place >= 0
                row, place, times = row[there], place[there], times[there]
                w = (1 + np.log(times)) * idf[place]
                w /= np.sqrt(np.bincount(row, w * w))[row] if len(row) else 1
                order = np.lexsort((place, row))
                rows, n = np.unique(row, return_counts=True)
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place[order].astype(np.int32), w[order])]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows + start)), *lists], names=["id", "places", "weights"])
        give_back()

    return texts.select("id", "words").mapInArrow(made, f"id {texts.schema['id'].dataType.simpleString()}, places array<int>, weights array<double>")


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _combined(kind: int, parts: list[np.ndarray]) -> np.ndarray:
    """Sums of matrices (kind 0), or the triangle of triangles."""
    return sum(parts[1:], start=parts[0]) if kind == 0 else _triangle(np.vstack(parts))


PIECES = "kind int, block int, salt int, rows int, data binary"


def _products(rows: DataFrame, basis, height: int) -> DataFrame:
    """Of each task: its part of (rows' transpose) * rows * basis, by blocks, and the triangle of rows * basis."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = basis.value
        width = q.shape[1]
        back, triangle = np.zeros_like(q), np.zeros((0, width))
        some = False
        for batch in batches:
            places, weights = (batch.column(c).flatten().to_numpy() for c in ("places", "weights"))
            ends = np.cumsum(pc.list_value_length(batch.column("places")).to_numpy()).tolist()
            out = np.empty((batch.num_rows, width))
            for k, (start, end) in enumerate(zip([0, *ends], ends)):
                at, w = places[start:end], weights[start:end]
                out[k] = w @ q[at]
                back[at] += np.outer(w, out[k])
            if batch.num_rows:
                triangle, some = _triangle(np.vstack([triangle, out])), True
        if some:
            salt = TaskContext.get().partitionId()  # the same if the task is run again
            for block in range(0, height, HEIGHT):
                yield _piece(0, block // HEIGHT, salt, back[block : block + HEIGHT])
            yield _piece(1, 0, salt, triangle)

    return rows.select("places", "weights").mapInArrow(made, PIECES)


def _piece(kind: int, block: int, salt: int, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": [kind], "block": [block], "salt": [salt], "rows": [len(a)], "data": [np.ascontiguousarray(a).tobytes()]}, schema=pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("salt", pa.int32()), ("rows", pa.int32()), ("data", pa.binary())]))


def _gathered(pieces: DataFrame, tasks: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of all tasks' products and the triangle of all rows, by a tree: FAN pieces or so meet in a task."""

    def met(table: pa.Table) -> pa.Table:
        kind, block = table.column("kind")[0].as_py(), table.column("block")[0].as_py()
        parts = [np.frombuffer(d.as_py(), np.float64).reshape(n.as_py(), width) for d, n in zip(table.column("data"), table.column("rows"))]
        return pa.Table.from_batches([_piece(kind, block, table.column("salt")[0].as_py(), _combined(kind, parts))])

    groups = tasks
    while groups > 1:
        groups = -(-groups // FAN)
        dealt = pieces.withColumn("salt", F.pmod("salt", F.lit(groups)))
        pieces = written(dealt.groupBy("kind", "block", "salt").applyInArrow(met, PIECES), "pieces")
    back, triangle = np.zeros((height, width)), np.zeros((0, width))
    for row in pieces.toArrow().to_pylist():  # one row a block, and one
        a = np.frombuffer(row["data"], np.float64).reshape(row["rows"], width)
        if row["kind"] == 0:
            back[row["block"] * HEIGHT : row["block"] * HEIGHT + len(a)] = a
        else:
            triangle = a
    return back, triangle


def decomposed(rows: DataFrame, height: int, dimensions: int = 96, more: int = 32, rounds: int = 6, tolerance: float = 1e-9, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(singular values in descending order, basis of height x dimensions: a text's vector is its weights times it).

    rows: (id, places, weights), places below height. Subspace iteration with more dimensions than are wanted, until no
    wanted value changes by more than tolerance times the first, rounds times at most. Fewer come out where the rows or
    the vocabulary have less. Signs: the entry of each column that is largest by amount is positive.
    """
    small_batches(rows.sparkSession)
    rows = written(rows.select("places", "weights"), "rows")
    n = rows.count()
    width = min(height, n, dimensions + more)
    if not width:
        return np.zeros(0), np.zeros((height, 0))
    if height * width * 8 > MOST_BYTES:
        raise ValueError(f"a basis of {height} x {width} has more than {MOST_BYTES} bytes")
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((height, width)))
    before: np.ndarray | None = None
    # each task sends a matrix of the basis's size: it is to have as much to do
    tasks = min(rows.rdd.getNumPartitions(), max(1, n // TASK_ROWS), max(FAN, rows.sparkSession.sparkContext.defaultParallelism))
    rows = rows.coalesce(tasks)
    for _ in range(rounds):
        basis = rows.sparkSession.sparkContext.broadcast(q)
        back, triangle = _gathered(_products(rows, basis, height), tasks, width, height)
        basis.unpersist()
        _, values, turn = np.linalg.svd(triangle)
        values = np.append(values, np.zeros(width))[:width]
        done = before is not None and np.abs(values - before)[:dimensions].max() <= tolerance * max(values[0], 1e-300)
        found, before = q @ turn.T, values
        if done:
            break
        q, _ = np.linalg.qr(back)
    keep = min(dimensions, width)
    found = found[:, :keep]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(keep)])
    return before[:keep], found * np.where(signs == 0, 1, signs)


def projected(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """(id, vector): rows times the basis, of length 1 (zeros stay zeros)."""
    held = rows.sparkSession.sparkContext.broadcast(basis)
    kind = rows.schema["id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, held.value.shape[1]))
            for k, (places, weights) in enumerate(zip(batch.column("places"), batch.column("weights"))):
                out[k] = weights.values.to_numpy() @ held.value[places.values.to_numpy()]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), max(1, out.shape[1])).cast(pa.list_(pa.float64())) if out.size else pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select("id", "places", "weights").mapInArrow(made, f"id {kind}, vector array<double>")
