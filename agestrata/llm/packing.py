"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids are cut into pieces whose lengths are the binary digits of their number (pieces of the longest length
first), and pieces of equal length share a bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import only, table

LONGEST = 2048
END = 1
#: Words whose ids a Python worker remembers; others are encoded anew.
CACHE = 250_000
# A word of its own that separates words encoded in one call; words that hold it are encoded alone.
MARK = "\x01"

_known: dict[str, tuple] = {}


def _encoder(path: str):
    """The tokenizer, its id of MARK and the ids (bytes) of words met before, kept while the worker lives."""
    if path not in _known:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        (mark,) = tok.encode(MARK, add_special_tokens=False).ids
        _known[path] = tok, mark, {}
    return _known[path]


def encode(words: set[bytes], path: str) -> dict[bytes, bytes]:
    """Ids of each word as little-endian unsigned 32-bit numbers. The tokenizer never joins across ASCII white space, so
    the ids of a text are those of its words; nor does it join a letter or digit with a mark, so those of a word with
    marks behind it are those of its stem, then those of the marks."""
    import numpy as np

    tok, mark, cache = _encoder(path)
    out, cut, todo = {}, {}, set()
    for w in words:
        stem = w.rstrip(b",.;:!?|")
        if b"\x01" in w or b"<|" in w:
            out[w] = np.array(tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        elif stem != w and stem[-1:].isalnum():
            cut[w] = (stem, w[len(stem) :])
            todo.update(x for x in cut[w] if x not in cache)
        else:
            todo.add(w)
    plain = list(todo)
    groups = [plain[k : k + 256] for k in range(0, len(plain), 256)]
    coded = tok.encode_batch_fast([f" {MARK} ".join(w.decode() for w in some) for some in groups], add_special_tokens=False)
    for some, code in zip(groups, coded, strict=True):
        ids = np.array(code.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == mark), len(ids)) * 4
        raw, at = ids.tobytes(), 0
        for w, end in zip(some, ends.tolist(), strict=True):
            out[w] = raw[at:end]
            at = end + 4
    if len(cache) < CACHE:
        cache.update(out)
    for w, (stem, marks) in cut.items():
        out[w] = (out[stem] if stem in out else cache[stem]) + (out[marks] if marks in out else cache[marks])
    return out


def _words(text: bytes | None) -> list[bytes]:
    """The tokenizer lowers case itself; doing so before makes words alike. Special tokens count only as they are written."""
    return [] if not text else text.split() if b"<|" in text else text.lower().split()


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as pieces of the longest length, then its remaining binary digits in descending order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end: int = END) -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    bucket (binary logarithm of length), sequence_id, offset.

    Each piece is a sequence. A null or empty text has the end id alone; equal rows are packed one by one, each with
    sequences of its own; an empty table gives no rows; other columns of docs are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"longest must be a power of two, not {longest}")
    last = end.to_bytes(4, "little")

    def pieces(batches):
        import pyarrow as pa

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=("doc_id", "start", "length", "ids", "doc_tokens"))

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 256):
                docs_ = [_words(x) for x in texts.slice(lo, 256).to_pylist()]
                known = _encoder(tokenizer)[2]
                new = {w for d in docs_ for w in d if w not in known}
                fresh = encode(new, tokenizer) if new else {}
                rows, held = [], 0
                for doc_id, words in zip(ids.slice(lo, 256).to_pylist(), docs_, strict=True):
                    raw = b"".join([known[w] if w in known else fresh[w] for w in words]) + last
                    at = 0
                    for n in lengths(len(raw) // 4, longest):
                        rows.append((doc_id, at, n, raw[4 * at : 4 * (at + n)], len(raw) // 4))
                        at += n
                    held += len(raw)
                    if held > 8_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    made = cut.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return made.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_power_of_two_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents")))
