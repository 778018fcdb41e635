"""SentencePiece encoding by a table of distinct chunks, and decoding.

In a model whose pieces cannot cross white space markers, a marker that follows another character
always starts a piece, so the merges on its two sides never meet. A text is cut there; each
distinct marked word is segmented once for each task's table (bounded; cleared when full), and ids
are joined back by position. The property is checked against the model's own vocabulary when it
is loaded; without it, or where the model changes or drops characters before segmenting, whole
texts are encoded by the library instead.

The model file is read by path on each executor, or shipped as bytes by the driver (the default:
half a megabyte, fixed by the tokenizer, whatever the corpus).

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length
are encoded whole; repeated rows give repeated results; ties between merges are the library's, leftmost first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_SIZE = 300_000  # distinct chunks that a task keeps
SLICE = 2_000_000  # characters whose ids are held at once, or one text
LONGEST_KEPT = 64  # characters; longer chunks are segmented each time, so the table stays small


class ChunkTable(dict):
    """Ids by chunk without its first marker. Missing chunks of a text are segmented together, and kept if there is room
    or made some; long ones are segmented where they are met."""

    def __init__(self, segment, size: int):
        super().__init__()
        self.segment, self.size = segment, size

    def __missing__(self, rest: str) -> tuple[int, ...]:
        return self.segment([rest])[0]

    def learn(self, rests: list[str]) -> None:
        new = [r for r in set(rests) if r not in self and len(r) < LONGEST_KEPT]
        if new:
            if len(self) + len(new) > self.size:
                self.clear()
                new = [r for r in set(rests) if len(r) < LONGEST_KEPT]
            # A text with more distinct chunks than the table holds has the others segmented as they come.
            new = new[: self.size]
            self.update(zip(new, self.segment(new), strict=True))


class ChunkEncoder:
    """Encodes texts exactly as the library, by distinct chunks."""

    def __init__(self, model: bytes, table_size: int = TABLE_SIZE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = ChunkTable(self.chunks_ids, table_size)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # Identity before segmenting, and one marker put in front: probed, not assumed.
        probe = "  a  ﬁ　\xa0B  "
        self.separable = not crossing and self.sp.decode(self.sp.encode(probe)) == probe
        self.mark_id = self.sp.piece_to_id(MARK)

    def chunks_ids(self, rests: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks without their first marker, which the library puts in front itself; it gives none for the
        empty rest, which stands for a marker alone."""
        found = self.sp.encode([r.replace(MARK, " ") for r in rests], num_threads=1)
        return [tuple(ids) if r else (self.mark_id,) for r, ids in zip(rests, found, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.separable:
            return self.sp.encode(text)
        # Where each space stands alone between words, words are the chunks; else runs of markers are kept together.
        if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            rests = text.split(" ")
        else:
            rests = [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        self.table.learn(rests)
        return list(chain.from_iterable(map(self.table.__getitem__, rests)))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all) with ``ids`` array<int>, and if asked for ``decoded_sha256``, of the text
    that the ids decode to; of clashing names, the new one stays."""
    model = model_bytes(path)
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "ids" and not (decoded and c == "decoded_sha256")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(model)
        for b in batches:
            part = np.cumsum([len(t) if t else 0 for t in b["_text"]]) // SLICE
            for _, some in b.groupby(part, sort=False):
                ids, sums = [], []
                for t in some["_text"]:
                    of = encoder.encode(t)
                    ids.append(np.array(of, dtype=np.int32))
                    if decoded:
                        sums.append(hashlib.sha256(encoder.decode(of).encode("utf-8", "surrogatepass")).hexdigest())
                made = some[keep].assign(ids=pd.Series(ids, index=some.index, dtype=object))
                yield made.assign(decoded_sha256=sums) if decoded else made

    fields = [docs.schema[c] for c in keep]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>", *(["decoded_sha256 string"] if decoded else [])])
    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(run, shape)


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what the id lists come to, made beside them
    so that lists of ids never leave the task."""
    model = model_bytes(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(model)
        name: list[str] = [str(i) for i in range(encoder.sp.get_piece_size())]
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = encoder.encode(t)
                listed = ",".join([name[i] for i in ids])
                decoded = encoder.decode(ids).encode("utf-8", "surrogatepass")
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
