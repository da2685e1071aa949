"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms are hashed byte trigrams, hashed character-class 4-grams, and levels of how much a text repeats its words and
lines. A bounded sample of labelled rows, balanced between the labels, gives term weights and, by a singular value decomposition, the
latent space; its vectors are broadcast. Every document's cosines with all of them are computed in blocks, exactly; the nearest
vote with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import texts

#: Labelled rows of each label that the model is fitted on, at most; the broadcast holds 2 * PER_LABEL * RANK floats (1 MB).
PER_LABEL = 2048
#: Dimensions of the latent space, and neighbours that vote.
RANK, NEIGHBOURS = 64, 25
GRAMS, SHAPES, LEVELS = 2048, 512, 24
TERMS = GRAMS + SHAPES + 2 * LEVELS
#: Texts that are compared with the sample at a time.
BLOCK = 512
#: A text is accepted from this score on.
ACCEPT = 0.7

# Character classes by byte: letters lower and upper, digits, space, line end, bytes of other letters; others each of their own.
_CLASS = np.arange(256, dtype=np.uint32) % 64 + 8
for _k, _span in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10, 13), range(128, 256))):
    _CLASS[list(_span)] = _k


def terms(bodies: list[str]) -> np.ndarray:
    """Logarithmic term counts, a row for each text."""
    out = np.zeros((len(bodies), TERMS), np.float32)
    for row, body in zip(out, bodies):
        b = np.frombuffer(f"  {body}  ".encode(), np.uint8).astype(np.uint32)
        tri = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(21)
        c = _CLASS[b]
        shape = ((c[:-3] << 21 | c[1:-2] << 14 | c[2:-1] << 7 | c[3:]) * np.uint32(0x85EBCA6B)) >> np.uint32(23)
        row[:GRAMS] = np.bincount(tri, minlength=GRAMS)
        row[GRAMS : GRAMS + SHAPES] = np.bincount(shape, minlength=SHAPES)
        words = body.split()
        n = len(words)
        again = sum(map(str.__eq__, words, words[1:])) / n if n else 0
        lines = [s for s in body.split("\n") if s]
        twice = 1 - len(set(lines)) / len(lines) if lines else 0
        for k, share in enumerate((again, twice)):
            row[GRAMS + SHAPES + k * LEVELS : GRAMS + SHAPES + k * LEVELS + int(share * (LEVELS - 1) + 0.999)] = max(8, n)
    return np.log1p(out, out=out)


class Model:
    """fit() on labelled texts' terms; score() for others."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, rank: int = RANK, seed: int = 5):
        n = len(x)
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        z = self._weigh(x)
        self.mean = z.mean(axis=0)
        z -= self.mean
        # Randomized decomposition: a random sketch of the row space, sharpened by two multiplications.
        q = np.random.default_rng(seed).standard_normal((z.shape[1], min(rank + 16, *z.shape))).astype(np.float32)
        for _ in range(3):
            q = np.linalg.qr(z.T @ (z @ q))[0].astype(np.float32)
        _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
        self.axes = (q @ vt.T)[:, :rank].astype(np.float32)
        self.vectors = self._place(z)
        self.good = y.astype(bool)
        share = self.good.mean() if n else 0
        # The sample is balanced; votes are weighed back to the labels' shares among all labelled rows, damped.
        self.weight = np.where(self.good, prior**0.5 / max(share, 1e-9), (1 - prior) ** 0.5 / max(1 - share, 1e-9)).astype(np.float32)
        self.prior = np.float32(prior)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        z = x * self.idf
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)

    def _place(self, z: np.ndarray) -> np.ndarray:
        v = z @ self.axes
        return (v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Texts go in blocks of BLOCK, the last filled up with zeros, so that products don't depend on how rows are batched. Of neighbours equally near the
        first in the sample count."""
        out = np.empty(len(x))
        k = min(k, len(self.vectors))
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            full = np.zeros((BLOCK, x.shape[1]), np.float32)
            full[: len(part)] = part
            cos = (self._place(self._weigh(full) - self.mean) @ self.vectors.T)[: len(part)]
            last = np.partition(cos, -k, axis=1)[:, -k, None]
            above, level = cos > last, cos == last
            near = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))))[1].reshape(len(part), k)
            vote = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6) ** 4 * self.weight[near]
            out[at : at + BLOCK] = (vote * self.good[near]).sum(axis=1) / vote.sum(axis=1)
        return np.round(np.clip(out, 0, 1), 6)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """A model of at most per_label labelled rows of each label that aren't held out: those of the least hashed ids.
    None where no label can be learned. The rows reach the driver as terms, a bounded number of bounded length."""
    known = labels.select(F.col(id_col).alias("of"), F.col(label).cast("int").alias("y")).where(F.col("of").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(F.crc32(F.col("of").cast("string").cast("binary")) % 4 != 2)
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return None
    order = [F.xxhash64("of", F.lit(29)), "of"]
    sample = known.where("y = 1").orderBy(*order).limit(per_label).unionByName(known.where("y = 0").orderBy(*order).limit(per_label))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = terms(part.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("of"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["of", "y", "x"])

    met = texts(docs, id_col, text=text).join(F.broadcast(sample), F.col(id_col) == F.col("of")).select("of", "y", "text")
    kind = met.schema["of"].dataType.simpleString()
    # Of several rows of an id the one of the least terms, so that reruns agree. At most 2 * per_label rows.
    rows = met.mapInArrow(read, f"of {kind}, y int, x binary").groupBy("of").agg(F.min(F.struct("x", "y")).alias("m")).select("of", "m.x", "m.y").collect()
    rows.sort(key=lambda r: r.of)
    if len({r.y for r in rows}) < 2:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    return Model(x, np.array([r.y for r in rows]), count[1] / (count[0] + count[1]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = ACCEPT, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Per row of docs: its id, the columns in carry, held_out, score (0 to 1), predicted (1 if score >= accept).

    Null texts are empty and are scored as such. Rows of one id are scored each; where the labelled sample meets several, the one of the least
    terms counts. Without labels of both kinds to learn from, every score is 1: nothing is known against a text. An empty table gives an
    empty one; columns not named are not read. The model alone is broadcast, of a size that per_label bounds; no shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, label, id_col=id_col, text=text, **options))

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = model.value
                s = m.score(terms(part.column("text").to_pylist())) if m else np.ones(part.num_rows)
                kept = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array((s >= accept).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

    extra = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *extra, fold(id_col) == 2, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).toDF("id", *[f"carry_{i}" for i in range(len(carry))], "held_out", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = rows.mapInArrow(score, f"{schema}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "held_out", "score", "predicted")
