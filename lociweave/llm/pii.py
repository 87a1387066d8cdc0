"""Personal information in free text: candidates, boosted trees, calibrated thresholds, typed placeholders."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, boost
from .pii_samples import sample
from .pii_spans import FAMILY, GIVEN, KINDS, Names, chosen, spans, table

#: Made-up labelled texts for fitting; half as many others are for calibration.
SAMPLE_SIZE = 8000
MOST_NAMES = 20_000


@dataclass
class Detector:
    models: dict[str, Boosted]
    thresholds: dict[str, float]
    names: Names

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Chosen spans (kind, start, end, probability) of a whole text, in order, none overlapping."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """`find` for many texts; the trees judge the candidates of all of them at once."""
        candidates: dict[str, list] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            for kind, a, b, f in spans(t, self.names) if t else ():
                candidates[kind].append((i, a, b, f))
        kept: list[list] = [[] for _ in texts]
        for kind, own in candidates.items():
            if own:
                p = self.models[kind].probability(table([c[3] for c in own], kind))
                for (i, a, b, _), q in zip(own, p):
                    if q >= self.thresholds[kind]:
                        kept[i].append((kind, a, b, float(q)))
        return [chosen(k) if k else [] for k in kept]


def _labelled(texts, names: Names) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rows: dict[str, list] = {k: [] for k in KINDS}
    marks: dict[str, list] = {k: [] for k in KINDS}
    for text, true in texts:
        right = set(true)
        for kind, a, b, f in spans(text, names):
            rows[kind].append(f)
            marks[kind].append((kind, a, b) in right)
    return {k: (table(rows[k], k), np.array(marks[k], bool)) for k in KINDS}


def calibrated(p: np.ndarray, y: np.ndarray, slack: float = 0.002) -> float:
    """The middle of the thresholds whose F1 on held-out candidates is within `slack` of the best; steadier than the best."""
    grid = np.linspace(0.05, 0.95, 91)
    hit = np.array([(y & (p >= t)).sum() for t in grid])
    f1 = 2 * hit / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + y.sum())
    good = grid[f1 >= f1.max() - slack]
    return float((good.min() + good.max()) / 2)


@lru_cache(maxsize=4)
def fit(known: tuple[tuple[str, str], ...], size: int = SAMPLE_SIZE, seed: int = 11) -> Detector:
    """Fit one model a kind on a made-up sample of `size` texts, and thresholds on half as many others.

    Features see only 60 % of the known and common names while fitting, so that the trees learn what names beyond the
    lists look like.
    """
    r = random.Random(seed)
    common = [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY]
    part = Names.of([k for k in known if r.random() < 0.6], [k for k in common if r.random() < 0.6])
    train, held = _labelled(sample(list(known), size, seed), part), _labelled(sample(list(known), size // 2, seed + 1), part)
    models, thresholds = {}, {}
    for kind in KINDS:
        models[kind] = boost(*train[kind])
        thresholds[kind] = calibrated(models[kind].probability(held[kind][0]), held[kind][1])
    return Detector(models, thresholds, Names.of(list(known), common))


def detector(known_names: DataFrame, size: int = SAMPLE_SIZE) -> Detector:
    """A detector for a list of known names (`name`, `name_part`), which has at most MOST_NAMES rows."""
    rows = known_names.select("name", "name_part").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    return fit(tuple(sorted({(x.name, x.name_part) for x in rows if x.name and x.name_part})), size)


def found(df: DataFrame, item: list[str], text: str, with_: Detector) -> DataFrame:
    """The pieces of personal information in `text`: the item's columns, kind, start (in code points, from 0), found_text.

    Whole texts are scanned where they lie, without an exchange. Null and empty texts give no rows; repeated rows give
    theirs again; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(with_)
    rows = df.select(*(F.col(f"`{c}`") for c in item), F.col(f"`{text}`").cast("string").alias("__text")).where("__text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, kind, start, piece = [], [], [], []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i, (t, hits) in enumerate(zip(texts, sent.value.find_all(texts))):
                for k, a, b, _ in hits:
                    of.append(i)
                    kind.append(k)
                    start.append(a)
                    piece.append(t[a:b])
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[:-1]), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(piece, pa.string())], names=[*batch.schema.names[:-1], "kind", "start", "found_text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("found_text", T.StringType())]))


def redacted(df: DataFrame, item: list[str], text: str, with_: Detector, *, name: str = "redacted_text") -> DataFrame:
    """The item's columns and `text` with every piece replaced by its placeholder, such as [EMAIL]; all else stays.

    Null texts stay null, texts without personal information stay as they are.
    """
    sent = df.sparkSession.sparkContext.broadcast(with_)
    rows = df.select(*(F.col(f"`{c}`") for c in item), F.col(f"`{text}`").cast("string").alias("__text"))

    def clean(t: str | None, hits: list) -> str | None:
        if not hits:
            return t
        out, at = [], 0
        for kind, a, b, _ in hits:
            out += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            cleaned = pa.array([clean(t, hits) for t, hits in zip(texts, sent.value.find_all(texts))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cleaned], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.StringType())]))
