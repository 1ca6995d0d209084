"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled texts. A text is
compressed with either, in blocks, so that the dictionaries matter all through
a long text; the difference of the two sizes, normalised by their sum, is the
only evidence, and a logistic curve of it, fitted on labelled texts that the
dictionaries don't hold, makes it a calibrated score.

Fitting uses whole texts of at most SAMPLE labelled rows, those with the smallest
hashes of their ids (the one bound there is); scoring covers whole texts of all
rows. Defined results: null and empty texts have no evidence and get the score
of difference 0; texts of any length are compressed whole; rows with a null id
are scored (never held out); repeated rows are scored each; equal texts get equal
scores; of an id's several texts the smallest is learnt, and of its several labels
each; columns other than the text are kept, but for one named as the score, which
is replaced; an empty table gives an empty result; with no labels of one kind, all
scores are that of the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewer

#: The bound of labelled rows used for fitting.
SAMPLE = 3000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 256 << 10, 1 << 10, 3
#: Segment and window length of the dictionary trainer.
TRAINING = {"k": 1000, "d": 8}


def _sizes(text: bytes, compressors) -> tuple[int, int]:
    """Compressed bytes with the good and with the bad dictionary, block by block."""
    good = bad = 0
    for k in range(0, len(text), BLOCK_BYTES):
        block = text[k : k + BLOCK_BYTES]
        good += len(compressors[0].compress(block))
        bad += len(compressors[1].compress(block))
    return good, bad


def difference(text: bytes, compressors) -> float:
    """The normalised difference of the sizes: positive where the good dictionary helps more; 0 for an empty text."""
    good, bad = _sizes(text, compressors)
    return (bad - good) / (bad + good) if text else 0.0


def _compressors(dictionaries: tuple[bytes, bytes]):
    import zstandard as z

    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **options) for d in dictionaries]


class Model:
    """Two dictionaries and the curve's weights; plain data, a few hundred kilobytes at most."""

    def __init__(self, dictionaries, weights):
        self.dictionaries, self.weights = dictionaries, weights

    def scores(self, texts):
        if self.dictionaries is None:
            return [self.weights[0]] * len(texts)
        made, (a, b) = _compressors(self.dictionaries), self.weights
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * difference((t or "").encode(), made))))) for t in texts]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) rows: dictionaries from one half of each kind, the curve from the other, so it sees texts that the dictionaries don't hold."""
    import zstandard as z

    kinds = {label: [(t or "").encode() for t, y in rows if y == label] for label in (1, 0)}
    if min(map(len, kinds.values())) < 6:
        return Model(None, [len(kinds[1]) / len(rows) if rows else 0.5])
    dictionaries = []
    for label in (1, 0):
        samples = [t[k : k + BLOCK_BYTES] for t in kinds[label][::2] for k in range(0, max(1, len(t)), BLOCK_BYTES)]
        samples = [b for b in samples if len(b) >= 16]
        try:
            dictionaries.append(z.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, **TRAINING).as_bytes())
        except z.ZstdError:  # too little text to train on: its raw content is a dictionary too
            dictionaries.append(b"".join(samples)[-DICTIONARY_BYTES:] or b" " * 8)
    made = _compressors(tuple(dictionaries))
    x = np.array([difference(t, made) for label in (1, 0) for t in kinds[label][1::2]])
    y = np.concatenate([np.full(len(kinds[label][1::2]), label) for label in (1, 0)])
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weights = np.zeros(2)
    for _ in range(50):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -40, 40)))
        weights += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * weights)
    return Model(tuple(dictionaries), [float(weights[0] - weights[1] * mean / scale), float(weights[1] / scale)])


def held_out(row_id: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out; the sample is chosen by the hash of the id, so it is the same in every run."""
    known = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id")).distinct()
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most `sample` ids
    rows = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample).collect()
    return fit([(r["_text"], r["_y"]) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score column (0 to 1; higher: label 1 is likelier)."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.drop(column).schema.add(column, "double")
    keep = [i for i, c in enumerate(docs.columns) if c != column]

    def run(batches):
        for few in fewer(batches):
            made = pa.array(given.value.scores(few.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([few.column(i) for i in keep] + [made], [few.schema.names[i] for i in keep] + [column])

    return docs.mapInArrow(run, schema)
