"""Token counts: lengths only, from Arrow batches, of texts cut at safe boundaries.

A cut before a space or line feed that follows a character which is no white
space leaves every pre-token whole: none reaches from such a character over
the cut, and no rule looks back. So the count of a text is the sum of the
counts of its pieces. Pieces repeat, hence each distinct piece of a batch is
encoded once, in calls balanced by bytes, and its length kept by the worker.

Null and empty texts count 0. Rows, ties and repeated rows pass one to one;
an empty table gives an empty result; columns other than the id and text are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.text import flat, worker_store

#: Python's white space holds that of the tokenizers, so a cut is safe for both.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A worker keeps the lengths of so many pieces at most (about 150 bytes each) and starts anew beyond.
KEPT_PIECES = 600_000
#: Longer pieces are encoded but not kept.
KEPT_CHARS = 48
#: Bytes of one call to the tokenizer.
CALL_BYTES = 1 << 18


def tokenizer(name: str):
    """The tokenizer of a vocabulary file, loaded once a worker; single-threaded."""
    store = worker_store()
    if ("tokenizer", name) not in store:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        if name.endswith(".json"):
            t = Tokenizer.from_file(public_tokenizers.path(name))
            t.no_truncation()
            t.no_padding()
            lengths = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            lengths = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
        store["tokenizer", name] = lengths
    return store["tokenizer", name]


def balanced(texts: Iterable[str], size: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about so many bytes."""
    run, n = [], 0
    for x in texts:
        run.append(x)
        n += (len(x) if x.isascii() else len(x.encode())) + 16
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def token_counts(texts: list[str | None], name: str) -> list[int]:
    """Tokens of each text. A model that isn't byte-level BPE gets its texts whole."""
    lengths = tokenizer(name)
    if not name.startswith("byte_"):
        out: list[int] = []
        for run in balanced([x or "" for x in texts]):
            out += lengths(run)
        return out
    kept = worker_store().setdefault(("pieces", name), {})
    pieces = [CUT.split(x) if x else [] for x in texts]
    new = list(set().union(*pieces) - kept.keys()) if pieces else []
    if len(kept) + len(new) > KEPT_PIECES:
        kept.clear()
        new = list(set().union(*pieces))
    for run in balanced(new):
        kept.update(zip(run, lengths(run), strict=True))
    out = [sum(map(kept.__getitem__, x)) for x in pieces]
    for x in new:
        if len(x) > KEPT_CHARS:
            del kept[x]
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", limit: int = 512, step_bytes: int = 1 << 21) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        for b in batches:
            offs = flat(b.column(1))[1]
            n_bytes, texts, i = np.diff(offs), b.column(1), 0
            while i < len(texts):  # steps balanced by bytes
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + step_bytes, side="right")) - 1)
                j = min(j, len(texts))
                n = np.array(token_counts(texts.slice(i, j - i).to_pylist(), name), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_bytes[i:j]), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
                i = j

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
