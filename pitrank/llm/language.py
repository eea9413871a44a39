"""Language of filing documents by a bidirectional recurrent network over bytes.

Records: filing documents (``filing_id``, ``document``, ``language``); the language is known for some of them.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .gru import WINDOW, Gru, Model, Reader, cut_windows, train
from .kinds import DOUBLE, STRING, arrays, struct
from .words import HASH_SLOTS, likely_first
from .worker import held, key_of

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
PREDICTION = struct(language=STRING, score=DOUBLE)
BLOCK_BYTES = 2_000_000


def learning_sample(filings: DataFrame, p: Gru) -> DataFrame:
    """(language, filing_id, windows): at most ``per_language`` filings of every language, chosen by id hash.

    Only ids with a small hash are ranked, some thousands per language; the chosen ones are broadcast to fetch texts, of
    which only the windows that are learned from leave their task. An id that is repeated is learned from once.
    """
    known = filings.where("language IS NOT NULL AND document IS NOT NULL AND filing_id IS NOT NULL")
    frequent = known.groupBy("language").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("language").orderBy(F.pmod(F.xxhash64("filing_id"), F.lit(HASH_SLOTS)), "filing_id")
    chosen = (known.select("language", "filing_id").join(F.broadcast(frequent), "language")
              .where(likely_first("filing_id", p.per_language, F.col("_n")))
              .withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= p.per_language)
              .select("filing_id").distinct())
    most = p.windows

    @F.arrow_udf("binary")
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([spread_windows(t.as_py().encode(), most).tobytes() for t in batch], pa.binary())

    return (known.select("filing_id", "language", "document").join(F.broadcast(chosen), "filing_id")
            .groupBy("language", "filing_id").agg(F.min(windows("document")).alias("windows")))


def spread_windows(data: bytes, most: int) -> np.ndarray:
    """Up to ``most`` full windows, evenly spread over the whole text; short texts are repeated to fill one."""
    if not data:
        return np.empty((0, WINDOW), np.uint8)
    if len(data) < WINDOW:
        data = (data + b" ") * (WINDOW // len(data) + 1)
    n = min(most, len(data) // WINDOW)
    starts = np.linspace(0, len(data) - WINDOW, n).astype(int)
    return np.stack([np.frombuffer(data, np.uint8, WINDOW, a) for a in starts])


def fit(filings: DataFrame, p: Gru = Gru()) -> tuple[list[str], Model]:
    """The languages learned, sorted, and the trained network (some thousand numbers); training is one task.

    Every language with a labelled text is learned, from ``per_language`` filings at most and ``windows`` short windows
    of each. Rows without language, id or text teach nothing; without any the model is empty. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["language"], r["filing_id"], r["windows"]) for b in batches for r in b.to_pylist())
        languages = sorted({r[0] for r in rows})
        number = {name: i for i, name in enumerate(languages)}
        windows = [np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in rows]
        labels = np.repeat([number[r[0]] for r in rows], [len(w) for w in windows])
        if not len(labels):
            return
        m = train(np.concatenate(windows), labels.astype(int), len(languages), p)
        state = {"languages": languages, "model": {k: [v.shape, v.ravel().tolist()] for k, v in m.items()}}
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(state)])], names=["state"])

    found = learning_sample(filings, p).repartition(1).mapInArrow(run, "state string").collect()
    if not found:
        return [], {}
    state = json.loads(found[0]["state"])
    return state["languages"], {k: np.array(v, np.float32).reshape(shape) for k, (shape, v) in state["model"].items()}


def predict_texts(texts: list[str], languages: list[str], reader: Reader | None) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if reader is None:
        return names, scores
    at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    i = 0
    while i < len(at):
        block, size = [], 0
        while i < len(at) and (not block or size < BLOCK_BYTES):
            data = texts[at[i]].encode()
            block.append((at[i], *cut_windows(data)))
            size += len(data)
            i += 1
        sums = reader.window_probabilities(np.concatenate([w for _, w, _ in block]),
                                           np.concatenate([s for _, _, s in block]))
        first = np.cumsum([0] + [len(w) for _, w, _ in block[:-1]])
        pooled = np.add.reduceat(sums.astype(np.float64), first, axis=0)
        for (row, _, s), q in zip(block, pooled):
            q = q / s.sum()
            names[row], scores[row] = languages[int(q.argmax())], min(1.0, float(q.max()))
    return names, scores


def language_of(document: Column | str, languages: list[str], model: Model) -> Column:
    """Struct (language, score) of a filing's text.

    The network labels every byte of the whole text; byte probabilities are averaged and the largest wins (ties: the
    first language). NULL texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language was learned. Repeated rows get equal results; other columns are not looked at.
    """
    key = key_of("language", languages, model)

    @F.arrow_udf(PREDICTION)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = held(key, lambda: Reader(model) if languages else None)
        for batch in batches:
            yield arrays(PREDICTION, predict_texts(batch.to_pylist(), languages, reader))
    return run(document)
