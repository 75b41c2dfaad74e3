"""Token counts of whole texts, as the SentencePiece library gives them.

Batch encoding happens in an Arrow function that hands back lengths only. A text is cut at *safe boundaries* and the
pieces are encoded in batches balanced by bytes. A boundary is safe between a character and one single blank followed
by a character that is no blank: no entry of the vocabulary holds a blank after another character (``Counter`` checks
this when it loads the model), so no merge crosses it, and the blank itself comes back as the prefix the library puts
before every piece. Pieces repeat, so lengths are remembered per worker, up to ``MEMO`` pieces.

Null and empty texts have no tokens. Very long texts need no more memory than their pieces. Other columns of the input
are ignored, so clashing names cannot occur.
"""

from __future__ import annotations

import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from plumbline.llm.groups import lean

MEMO = 500_000
BATCH_BYTES = 1 << 18
LONGEST_REMEMBERED = 64
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def pieces(self, text: str) -> list[str]:
        if not text or not self.cut:
            return [text] if text else []
        if text[0] == " " or text[-1] == " " or "  " in text or "▁" in text:
            return _SAFE.split(text)
        return text.split(" ")

    def learn(self, new: list[str]) -> list[int]:
        """Lengths of pieces, encoded in batches of about BATCH_BYTES."""
        out: list[int] = []
        batch: list[str] = []
        held = 0
        for p in new:
            batch.append(p)
            held += len(p)
            if held >= BATCH_BYTES:
                out += map(len, self.model.encode(batch, num_threads=1))
                batch, held = [], 0
        if batch:
            out += map(len, self.model.encode(batch, num_threads=1))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [self.pieces(t or "") for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known)) if parts else []
        fresh = dict(zip(new, self.learn(new), strict=True))
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_REMEMBERED)
        known = self.known
        long = {p: n for p, n in fresh.items() if len(p) > LONGEST_REMEMBERED}
        if not long:
            return [sum(map(known.__getitem__, p)) for p in parts]
        return [sum(known[x] if x in known else long[x] for x in p) for p in parts]


def counter(model: str) -> Counter:
    if model not in _counters:
        _counters[model] = Counter(model)
    return _counters[model]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``."""

    def run(batches):
        count = counter(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            tokens: list[int] = []
            start = held = 0
            for i, size in enumerate(sizes):
                held += size
                if held >= 4 * BATCH_BYTES or i + 1 == len(sizes):
                    tokens += count.counts(texts[start : i + 1])
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
