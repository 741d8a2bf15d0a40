"""Language ID by a byte convolutional network, trained in numpy on labelled text.

Lower-cased UTF-8 bytes are embedded, filters of several widths slide over them, their maxima over a window of fixed
length feed a softmax. A text is cut into windows throughout; its probabilities are the mean of theirs by length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.llm.shared import by_place, only, table, unit, written

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED = 8
FILTERS = 16
EPOCHS = 12
#: The bound of the training sample: so many documents of each language, of each at most so many windows, drawn from
#: its whole text.
DOCS_OF_EACH = 400
WINDOWS_OF_EACH = 3
#: The most languages whose counts are broadcast.
SMALL = 10_000
NONE = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # longest width * EMBED x filters of all widths; narrower filters end in zeros
    bias: np.ndarray
    dense: np.ndarray  # filters x langs
    out: np.ndarray


def _mask() -> np.ndarray:
    m = np.zeros((max(WIDTHS), EMBED, len(WIDTHS), FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k] = 1
    return m.reshape(max(WIDTHS) * EMBED, -1)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes in rows of WINDOW, the last padded with zeros, and how many bytes each row has."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    rows = np.zeros(n * WINDOW, np.uint8)
    rows[: len(raw)] = raw
    lengths = np.full(n, WINDOW, np.float32)
    lengths[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return rows.reshape(n, WINDOW), lengths


def _columns(model: Model, rows: np.ndarray) -> np.ndarray:
    """For each row and position, the embeddings of the bytes under the widest filter."""
    wide = max(WIDTHS)
    x = model.embed[np.pad(rows, ((0, 0), (0, wide - 1)))]
    return np.concatenate([x[:, j : j + WINDOW] for j in range(wide)], axis=2)


def forward(model: Model, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities, a row for each window."""
    pooled = (_columns(model, rows) @ model.conv).max(axis=1)
    z = np.maximum(pooled + model.bias, 0) @ model.dense + model.out
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the mean cross-entropy, languages weighted alike. The same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    wide, many, mask = max(WIDTHS), len(WIDTHS) * FILTERS, _mask()
    p = [
        rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.2, (wide * EMBED, many)) * mask, np.zeros(many),
        rng.normal(0, 0.2, (many, len(langs))), np.zeros(len(langs)),
    ]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    share = np.bincount(labels, minlength=len(langs))
    weight = (len(labels) / len(langs) / np.maximum(share, 1))[labels].astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), 32):
            at = order[k : k + 32]
            model = Model(langs, *p)
            x = _columns(model, rows[at])
            conv = x @ p[1]
            best = conv.argmax(axis=1)  # window, filter
            pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0] + p[2]
            h = np.maximum(pooled, 0)
            z = h @ p[3] + p[4]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(len(at)), labels[at]] -= 1
            dz *= (weight[at] / len(at))[:, None]
            dh = (dz @ p[3].T) * (pooled > 0)
            under = np.take_along_axis(x, best[:, :, None], 1)  # window, filter, what the filter saw at its maximum
            dconv = np.einsum("bf,bfc->cf", dh, under) * mask
            seen = np.pad(rows[at], ((0, 0), (0, wide - 1)))[np.arange(len(at))[:, None, None], best[:, :, None] + np.arange(wide)]
            dx = (dh[:, :, None] * p[1].T[None]).reshape(len(at), many, wide, EMBED)
            dembed = np.zeros_like(p[0])
            np.add.at(dembed, seen.ravel(), dx.reshape(-1, EMBED))
            step += 1
            for i, g in enumerate((dembed, dconv, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = (p[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Model(langs, *p)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, docs_of_each: int = DOCS_OF_EACH) -> Model | None:
    """A model from a sample of at most docs_of_each labelled documents of each language, none of them held out; None
    if there are none. The sample is drawn by a hash of doc_id, and so are the places of its WINDOWS_OF_EACH windows in
    the whole text of each; only these windows cross the driver."""
    known = only(docs, "doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.withColumn("u", unit(F.lit("language"), "doc_id"))
    counts = written(known.groupBy("lang").count(), "languages")
    # a row for each language; texts are not shuffled to meet it unless there are very many
    likely = known.join(F.broadcast(counts) if counts.count() <= SMALL else counts, "lang").filter(F.col("u") * F.col("count") <= 3 * docs_of_each)
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    sample = likely.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= docs_of_each)
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1  # places where a window may start
    pieces = [F.col("text").substr((F.floor(unit(F.lit(k), "doc_id") * spare) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_OF_EACH)]
    sample = sample.select("lang", "rank", F.array_distinct(F.array(*pieces)).alias("pieces")).collect()
    if not sample:
        return None
    langs = sorted({r.lang for r in sample})
    rows, labels = [], []
    for r in sorted(sample, key=lambda r: (r.rank, r.lang)):
        for piece in r.pieces:
            if _LETTER.search(piece):
                rows.append(windows(piece)[0][0])
                labels.append(langs.index(r.lang))
    return train(np.array(rows), np.array(labels), langs) if rows else None


def probabilities(texts: list[str], model: Model) -> list[np.ndarray]:
    """Probabilities of each text; windows of several texts go through the network together, at most 512 at once."""
    sums, todo, owner, lens = [np.zeros(len(model.langs)) for _ in texts], [], [], []

    def go():
        prob = np.exp(forward(model, np.concatenate(todo))) * np.concatenate(lens)[:, None]
        for k, row in zip(np.repeat(owner, [len(t) for t in todo]).tolist(), prob, strict=True):
            sums[k] += row
        todo.clear(), owner.clear(), lens.clear()

    held = 0
    for k, t in enumerate(texts):
        rows, lengths = windows(t)
        for lo in range(0, len(rows), 256):
            todo.append(rows[lo : lo + 256])
            lens.append(lengths[lo : lo + 256])
            owner.append(k)
            held += len(todo[-1])
            if held >= 256:
                go()
                held = 0
    if todo:
        go()
    return [s / s.sum() for s in sums]


def tell(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    at = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
    langs, score = [NONE] * len(texts), [0.0] * len(texts)
    for i, p in zip(at, probabilities([texts[i] for i in at], model) if at else [], strict=True):
        langs[i], score[i] = model.langs[int(p.argmax())], float(min(1.0, p.max()))
    return langs, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs, from whole texts.

    Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned;
    equal texts get equal answers; an empty table gives no rows; other columns of docs are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                langs, score = tell(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=("doc_id", "lang_pred", "score"))

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return cut.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs whose language is told with at least this score, with all their columns; texts without a letter
    (null and empty ones too) go. Where nothing could be learned there is nothing to judge by, and every text with a letter
    stays. Rows of equal text stay or go together, very long texts are read whole, an empty table stays empty."""
    model, at = learn(docs), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(at).to_pylist()
                if model:
                    stay = [x != NONE and y >= least for x, y in zip(*tell(texts, model), strict=True)]
                else:
                    stay = [bool(t and _LETTER.search(t)) for t in texts]
                yield part.filter(pa.array(stay, pa.bool_()))

    return by_place(docs, run)


def op10_byte_cnn_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
