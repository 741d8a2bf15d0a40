"""Token counts: texts are cut at safe boundaries, encoded by the library in batches of equal bytes, lengths alone return.

The tokenizer joins neighbouring symbols only into pieces of its vocabulary. So between two characters that no piece has
side by side no join ever happens, and the tokens of a text are those of the stretches between such places: they are safe
boundaries, found from the vocabulary itself. A space after another character is one; where a long text has none, others
are looked for. The library takes longer for a long text than for its parts, so cutting saves time as well as memory.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import only, table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Bytes of text in a batch, code points in one call of the library, and in a part before it is cut.
BATCH, CALL, PART = 1 << 20, 1 << 18, 1000
_SPACE = "▁"
_WORD = re.compile(r"(?<! ) ")


class TokenCounter:
    """Numbers of tokens by one model, as its library gives them for whole texts without added tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i).replace(_SPACE, " ") for i in range(self.model.vocab_size()) if not self.model.is_byte(i)]
        #: Characters that some piece has side by side.
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        if any("\n" in p or p[1] == " " != p[0] for p in self.joined) or len(self.model.encode("\n")) != 2:
            raise ValueError("the model joins line ends, or spaces to the words before them")

    def parts(self, text: str, most: int = PART):
        """Parts of a text, of about so many code points, and how many tokens each has more than the library says.

        The library puts a space before all it gets. A part that begins with a space is therefore given without it; any
        other is marked by two line ends, which stand apart from their neighbours and are, with that space, three tokens
        too many.
        """
        text, at, lead, more = text.replace(_SPACE, " "), 0, "", 0
        while at < len(text):
            end = len(text)
            if end - at > most:
                word = _WORD.search(text, at + most, at + 2 * most)
                end = word.start() if word else next((k for k in range(at + most, end) if text[k - 1 : k + 1] not in self.joined), end)
            yield lead + text[at:end], more
            at, lead, more = end, "\n\n", -3
            if text[at : at + 1] == " ":
                at, lead, more = at + 1, "", 0
                if at == len(text):
                    yield "", 1

    def __call__(self, texts: list[str], most: int = PART, call: int = CALL) -> list[int]:
        """Numbers of tokens of some texts, in calls of about so many code points."""
        sums, owners, own, held = [0] * len(texts), [], [], 0

        def ask():
            for i, ids in zip(owners, self.model.encode(own, num_threads=1), strict=True):
                sums[i] += len(ids)

        for i, text in enumerate(texts):
            for part, more in self.parts(text, most):
                sums[i] += more
                owners.append(i), own.append(part)
                held += len(part)
                if held >= call:
                    ask()
                    owners, own, held = [], [], 0
        ask()
        return sums


_known: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    """The counter of a model, kept while the worker lives."""
    if path not in _known:
        _known[path] = TokenCounter(path)
    return _known[path]


def _balanced(sizes: list[int], most: int = BATCH):
    """Places (begin, end) of neighbouring texts that have about so many bytes together; longer texts are alone."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def counted(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of docs, whole texts.

    A null text is empty and has no bytes and no tokens; null ids and equal rows have a row each; an empty table gives no
    rows; other columns are ignored. Strings that look like special tokens are plain text, the library's default.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)

    def run(batches):
        count = _counter(model)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            sizes = pc.binary_length(texts).cast(pa.int64())
            for begin, end in _balanced(sizes.to_pylist()):
                n = end - begin
                tokens = pa.array(count(texts.slice(begin, n).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, n), sizes.slice(begin, n), tokens], names=("doc_id", "n_bytes", "n_tokens"))

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return cut.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir):
    return counted(table(spark, sf_dir, "documents"))
