"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature.

Word vectors are learned for the ids of a byte-level tokenizer, which has whole frequent words and cuts the rest into
word parts; a rarer word's vector is that of its parts. So every text is made of words of one fixed list: each has a
vector of its own at any size of the corpus, none is left out, and the table of vectors has a size that the vocabulary
file states (50,257 rows of 128 bytes here).

Every id has a sparse ternary index vector drawn from a hash. A word vector is the sum of the index vectors around all
its occurrences in the whole corpus; sums are integers, so they don't depend on the order of rows or tasks. A document
pools the vectors of its ids, and the products of index vectors of whole words near each other (runs of letters, digits
or signs, by 64-bit hash), by which repetition shows. Word vectors are rounded to whole steps, so pooled sums are exact
too and equal texts score alike.

Texts are encoded once and kept with the columns they came with (cut); one pass adds up the contexts, one pools and
scores. Nothing else is shuffled than context sums, in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, mix64, span_hashes, table
from .tokens import encoder, forget, vocabulary

WIDTH, NONZERO, REACH = 64, 8, 2
#: Steps of a unit vector's components.
STEPS = 4096
#: Words in a row of context sums, and the tasks whose sums meet in a first-level group.
ROW, TASKS = 2048, 1000
#: At most so many labelled documents are fitted on, those with the smallest hashes of doc_id.
SAMPLE = 12_000
THRESHOLD = 0.3
#: Words, and texts, worked on at a time.
CHUNK, TOGETHER = 100_000, 200


def _classes() -> np.ndarray:
    kind = np.full(256, 3, dtype=np.int8)
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    return kind


CLASSES = _classes()


def word_ids(data: bytes) -> np.ndarray:
    """Hashes of the whole words of UTF-8 bytes, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    kind = CLASSES[raw]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    ends = np.concatenate((starts[1:], [len(raw)]))
    keep = kind[starts] > 0
    return span_hashes(raw, starts[keep], ends[keep])


def _stretches() -> np.ndarray:
    """The entries that each byte of a hash draws: its two halves say where in a stretch the +1 or -1 stands."""
    step = WIDTH // NONZERO
    out = np.zeros((256, 2 * step), dtype=np.int8)
    for half in range(2):
        drawn = np.arange(256) >> 4 * half & 15
        out[np.arange(256), step * half + drawn % step] = 1 - 2 * (drawn // step)
    return out


STRETCHES = _stretches()


def drawn_vectors(words: np.ndarray) -> np.ndarray:
    """NONZERO entries of +1 or -1 for each hash, one in each stretch of WIDTH / NONZERO."""
    drawn = mix64(words ^ np.uint64(0x5851F42D4C957F2D)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return STRETCHES[drawn[:, : NONZERO // 2]].reshape(-1, WIDTH)


def index_vectors(n: int) -> np.ndarray:
    """The index vector of each id below n; one more row of zeros stands for a gap."""
    return np.concatenate((drawn_vectors(mix64(np.arange(1, n + 1, dtype=np.uint64))), np.zeros((1, WIDTH), np.int8)))


def repeats(data: bytes) -> np.ndarray:
    """Sums over a text of the products of the index vectors of words one and two apart, and the number of words."""
    words, out = word_ids(data), np.zeros(WIDTH + 1, dtype=np.int64)
    out[-1] = len(words)
    for at in range(0, len(words), CHUNK):
        own = drawn_vectors(words[at : at + CHUNK + REACH])
        for d in range(1, REACH + 1):
            both = own[: len(own) - d] * own[d:]
            out[:-1] += both[:CHUNK].sum(axis=0, dtype=np.int32)
    return out


def _size(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size()


def tokenised(docs: DataFrame, keep: tuple[str, ...], path: str) -> DataFrame:
    """(row struct of the columns keep, id, ids, repeats) of each row of docs; ids as little-endian integers, none for a null text."""

    @F.arrow_udf("ids binary, repeats binary")
    def encoded(texts: pa.Array) -> pa.Array:  # only the text goes to Python; the row waits for the result
        enc, ids, again = encoder(path), [], []
        for at in range(0, len(texts), 256):
            some = texts.slice(at, 256).to_pylist()
            ids += enc.encode(some)
            again += [repeats((t or "").encode()).astype("<i4").tobytes() for t in some]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(again, pa.binary())], ["ids", "repeats"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").cast("long").alias("id"), encoded(F.col("text").cast("string")).alias("x"))
    return cut(rows.select("row", "id", "x.ids", "x.repeats"), "ids")


def _pieces(column: pa.Array, dtype: np.dtype, gap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, starts) of some texts together, each text followed by REACH gaps; a text of more than CHUNK ids is alone."""
    sizes = np.array([len(x.as_buffer()) // dtype.itemsize if x.is_valid else 0 for x in column], dtype=np.int64)
    first = 0
    while first < len(sizes):
        last, n = first, 0
        while last < len(sizes) and (last == first or n + sizes[last] <= CHUNK and last - first < TOGETHER):
            n += int(sizes[last]) + REACH
            last += 1
        ids = np.full(n, gap, dtype=np.int32)
        starts = np.cumsum(sizes[first:last] + REACH) - sizes[first:last] - REACH
        for at, size, i in zip(starts.tolist(), sizes[first:last].tolist(), range(first, last)):
            if size:
                ids[at : at + size] = np.frombuffer(column[i].as_buffer(), dtype)
        yield first, last - first, ids, starts
        first = last


def _near(own: np.ndarray) -> np.ndarray:
    near = np.zeros_like(own)
    for d in range(1, REACH + 1):
        near[d:] += own[:-d]
        near[:-d] += own[d:]
    return near


def added(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the rows of each); rows are int8 between -4 and 4.

    Eight entries are added at a time as bytes of a 64-bit integer, over at most 31 rows, so that no byte overflows.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((first, [len(keys)])))
    runs = -(-sizes // 31)
    starts = np.repeat(first, runs) + 31 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    packed = (rows + np.int8(4)).view(np.uint64)[order]
    some = np.add.reduceat(packed, starts, axis=0).view(np.uint8).astype(np.int32)
    some -= 4 * np.diff(np.concatenate((starts, [len(keys)]))).astype(np.int32)[:, None]
    return keys[first], np.add.reduceat(some, np.cumsum(runs) - runs, axis=0)


def word_vectors(texts: DataFrame, path: str) -> np.ndarray:
    """Vectors of all words over all texts (column ids), one row a word: unit context vector plus half the unit index vector, in steps."""
    n, dtype = _size(path), encoder(path).dtype
    rows = -(-n // ROW)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        index, total = index_vectors(n), np.zeros((rows * ROW, WIDTH), dtype=np.int64)
        for b in batches:
            for _, _, ids, _ in _pieces(b.column(0), dtype, n):
                for at in range(0, len(ids), CHUNK):
                    lead, m = min(at, REACH), min(CHUNK, len(ids) - at)
                    near = _near(index[ids[at - lead : at + m + REACH]])[lead : lead + m]
                    found, some = added(np.ascontiguousarray(near), ids[at : at + m].astype(np.uint16 if n < 1 << 16 else np.int32))
                    real = found < n
                    total[found[real]] += some[real]
        some = [i for i in range(rows) if total[i * ROW : (i + 1) * ROW].any()]
        group = TaskContext.get().partitionId() // TASKS
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([group] * len(some), pa.int32()), pa.array([_narrow(total[i * ROW : (i + 1) * ROW]) for i in some], pa.binary())], ["block", "tasks", "sums"])

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROW * WIDTH, dtype=np.int64)
        for t in tables:
            for x in t.column("sums"):
                total += _wide(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([_narrow(total)], pa.binary())], ["block", "tasks", "sums"])

    schema = "block int, tasks int, sums binary"
    found = texts.select("ids").mapInArrow(sums, schema).groupBy("block", "tasks").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    total = np.zeros((rows * ROW, WIDTH), dtype=np.int64)
    for r in found.collect():  # as many rows as the vocabulary has stretches
        total[r.block * ROW : (r.block + 1) * ROW] = _wide(bytes(r.sums)).reshape(ROW, WIDTH)
    return in_steps(total[:n], index_vectors(n)[:-1])


def in_steps(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    unit = context / np.maximum(np.linalg.norm(context.astype(np.float64), axis=1, keepdims=True), 1)
    return np.rint(STEPS * (unit + 0.5 * index / np.sqrt(NONZERO))).astype(np.int16)


def pooled(column: pa.Array, again: pa.Array, vectors: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Features of each text: mean word vector, and mean products of near words (zeros without words).

    Texts that are worked on together are one product of their word counts and the vectors of the words they hold; all
    sums are whole numbers that doubles hold exactly.
    """
    n, out = len(vectors), np.zeros((len(column), 2 * WIDTH))
    place = np.zeros(n + 1, dtype=np.int64)
    for first, rows, ids, starts in _pieces(column, dtype, n):
        sizes = np.diff(np.concatenate((starts, [len(ids)])))
        held = np.flatnonzero(np.bincount(ids, minlength=n + 1)[:n])
        place[:], place[held] = len(held), np.arange(len(held))
        key = np.repeat(np.arange(rows), sizes) * (len(held) + 1) + place[ids]
        counts = np.bincount(key, minlength=rows * (len(held) + 1)).reshape(rows, -1)[:, :-1].astype(np.float64)
        out[first : first + rows, :WIDTH] = counts @ vectors[held].astype(np.float64) / (STEPS * np.maximum(sizes - REACH, 1))[:, None]
    near = np.frombuffer(b"".join(again.to_pylist()), "<i4").reshape(-1, WIDTH + 1)
    out[:, WIDTH:] = near[:, :-1] / np.maximum(near[:, -1:], 1)
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Integers with the sign in the lowest bit, in as few bytes as the largest needs, compressed byte by byte."""
    import zstandard

    x = x.ravel().astype(np.int64)
    x = (x << 1 ^ x >> 63).astype("<u8")
    size = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k)
    planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _wide(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    x = np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.uint64)
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


@dataclass
class Model:
    """Standardised features, a tanh layer, a logistic output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            p = min(max(self.prior, 1e-3), 1 - 1e-3)
            return np.full(len(x), np.log(p / (1 - p)))
        a, b, c, d = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over shuffled batches with a fixed seed; every fifth row only calibrates the temperature."""
    x = x.astype(np.float64)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(2 * WIDTH), x.std(axis=0) + 1e-6 if len(x) else np.ones(2 * WIDTH), prior=float(y.mean()) if len(y) else 0.5)
    if len(y) < 10 or y.min() == y.max():
        return model
    aside = np.arange(len(y)) % 5 == 4
    z, t = (x[~aside] - model.mean) / model.scale, y[~aside]
    drawn = np.random.default_rng(5)
    p = [drawn.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), drawn.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = drawn.permutation(len(t))
        for at in range(0, len(t), 256):
            i = order[at : at + 256]
            a = np.tanh(z[i] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - t[i]) / len(i)
            back = error[:, None] * p[2] * (1 - a * a)
            slopes = [z[i].T @ back + decay * p[0], back.sum(axis=0), a.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = p
    raw, truth = model.logits(x[aside]), y[aside]
    losses = {}
    for temperature in np.exp(np.linspace(np.log(0.5), np.log(8), 60)):
        q = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -40, 40))), 1e-9, 1 - 1e-9)
        losses[float(temperature)] = -float(np.mean(truth * np.log(q) + (1 - truth) * np.log(1 - q)))
    model.temperature = min(losses, key=losses.get)
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(texts: DataFrame, labels: DataFrame, vectors: np.ndarray, path: str, sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` labelled rows that aren't held out; texts has id and ids.

    Labels without id or quality are ignored; several labels of a document give its mean, from 0.5 on good; of several
    rows of a document the one with the smallest hash of its text counts. Without two classes of labels every score is
    the share of good labels (0.5 without any). Other columns of labels are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).join(texts.select("id").distinct(), "id", "left_semi")
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # the documented bound
    taken = texts.select("id", "ids", "repeats").join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("ids").alias("h"), F.col("ids"), F.col("repeats"))).alias("x"))
    dtype = encoder(path).dtype
    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(2), b.column(3), shared.value, dtype)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    rows = taken.select("id", "y", "x.ids", "x.repeats").mapInArrow(run, "id long, y int, x binary").orderBy(F.xxhash64("id"), "id").collect()  # at most `sample` rows of 1 KB
    x = np.array([np.frombuffer(bytes(r.x)) for r in rows]).reshape(len(rows), 2 * WIDTH)
    return fit(x, np.array([r.y for r in rows], dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(row struct of the columns keep, score double) of each row of docs, in one pass over its encoded texts."""
    path = path or vocabulary()
    texts = tokenised(docs, keep, path)
    vectors = word_vectors(texts, path)
    model, dtype = learn(texts, labels, vectors, path, sample), encoder(path).dtype
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    @F.arrow_udf("double")
    def judged(ids: pa.Array, again: pa.Array) -> pa.Array:
        forget()
        table_, fitted = shared.value
        return pa.array(np.round(fitted.score(pooled(ids, again, table_, dtype)), 9), pa.float64())

    return texts.select("row", judged("ids", "repeats").alias("score"))


def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over shuffled batches with a fixed seed; every fifth row only calibrates the temperature."""
    x = x.astype(np.float64)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(2 * WIDTH), x.std(axis=0) + 1e-6 if len(x) else np.ones(2 * WIDTH), prior=float(y.mean()) if len(y) else 0.5)
    if len(y) < 10 or y.min() == y.max():
        return model
    aside = np.arange(len(y)) % 5 == 4
    z, t = (x[~aside] - model.mean) / model.scale, y[~aside]
    drawn = np.random.default_rng(5)
    p = [drawn.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), drawn.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = drawn.permutation(len(t))
        for at in range(0, len(t), 256):
            i = order[at : at + 256]
            a = np.tanh(z[i] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - t[i]) / len(i)
            back = error[:, None] * p[2] * (1 - a * a)
            slopes = [z[i].T @ back + decay * p[0], back.sum(axis=0), a.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = p
    raw, truth = model.logits(x[aside]), y[aside]
    losses = {}
    for temperature in np.exp(np.linspace(np.log(0.5), np.log(8), 60)):
        q = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -40, 40))), 1e-9, 1 - 1e-9)
        losses[float(temperature)] = -float(np.mean(truth * np.log(q) + (1 - truth) * np.log(1 - q)))
    model.temperature = min(losses, key=losses.get)
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(texts: DataFrame, labels: DataFrame, vectors: np.ndarray, path: str, sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` labelled rows that aren't held out; texts has id and ids.

    Labels without id or quality are ignored; several labels of a document give its mean, from 0.5 on good; of several
    rows of a document the one with the smallest hash of its text counts. Without two classes of labels every score is
    the share of good labels (0.5 without any). Other columns of labels are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).join(texts.select("id").distinct(), "id", "left_semi")
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # the documented bound
    taken = texts.select("id", "ids", "repeats").join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("ids").alias("h"), F.col("ids"), F.col("repeats"))).alias("x"))
    dtype = encoder(path).dtype
    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(2), b.column(3), shared.value, dtype)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    rows = taken.select("id", "y", "x.ids", "x.repeats").mapInArrow(run, "id long, y int, x binary").orderBy(F.xxhash64("id"), "id").collect()  # at most `sample` rows of 1 KB
    x = np.array([np.frombuffer(bytes(r.x)) for r in rows]).reshape(len(rows), 2 * WIDTH)
    return fit(x, np.array([r.y for r in rows], dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(row struct of the columns keep, score double) of each row of docs, in one pass over its encoded texts."""
    path = path or vocabulary()
    texts = tokenised(docs, keep, path)
    vectors = word_vectors(texts, path)
    model, dtype = learn(texts, labels, vectors, path, sample), encoder(path).dtype
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, fitted = shared.value
        for b in batches:
            x = pooled(b.column(1), b.column(2), table_, dtype)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(fitted.score(x), 9))], ["row", "score"])

    found = texts.select("row", "ids", "repeats")
    return found.mapInArrow(run, found.select("row", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, labels: DataFrame, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with a double column score (0 to 1); the text alone decides it, so equal texts score alike.

    Null text counts as empty and scores like it; texts of any length are read whole; repeated rows stay; other columns
    pass through unchanged, whatever their names, but an own column score is replaced; an empty table gives an empty result.
    """
    keep = tuple(c for c in docs.columns if c != "score")
    return scored(docs, labels, keep, path, sample).select("row.*", "score")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score at least threshold, with all their own columns (an own score too) unchanged; else as score."""
    return scored(docs, labels, tuple(docs.columns), path, sample).where(F.col("score") >= threshold).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ("doc_id",))
    doc = F.col("row.doc_id")
    return found.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
