"""Best-fit packing of tokenized documents into fixed-length training sequences.

Every document becomes its token ids and an end id. Only documents longer than a sequence are cut. The
pieces are packed by vector best-fit: a bin is a sequence with three residual capacities (tokens,
documents, attention cost = sum of squared piece lengths); pieces come in falling length and each goes
to the open bin that keeps every capacity and is best by weighted dot product or by residual norm.

A task packs the pieces it has tokenized in blocks of bounded size, so nothing is shuffled, no key can be
hot, and memory is bounded by ``block_tokens``; the price is at most a few part-filled sequences a block.

Defined cases: what isn't UTF-8 counts as U+FFFD; null text is the empty text (one piece, the end id alone); repeated rows are packed as
often as they come, and so are rows with null ids; pieces of equal length go in the order of the input, and of bins that are equally
good the first one is taken; very long texts are tokenized whole; an empty table gives an empty result; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, valid_text, worker_model


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence; ``cost`` bounds the sum of squared piece lengths (None: tokens squared)."""

    tokens: int = 2048
    documents: int = 2048
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost or self.tokens**2], float)


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece over a capacity by itself gets a bin of its own."""
    n = len(lengths)
    limits, w = cap.vector(), np.array(cap.weights)
    bins, offsets = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if n else 0
    room = np.empty((3, max(n, 1)))  # residuals of open bins, as shares of the capacities
    ids, used = np.empty(max(n, 1), np.int64), np.zeros(max(n, 1), np.int64)
    n_open = n_bins = 0
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1, size * size]) / limits
        open_ = room[:, :n_open]
        left = open_ - need[:, None]
        fits = np.flatnonzero(left.min(axis=0) > -1e-12) if n_open else ()
        at = -1
        if len(fits):
            if cap.rule == "dot":
                score = -(open_[:, fits] * (w * need)[:, None]).sum(axis=0)
            else:
                left = left[:, fits]
                score = (w[:, None] * left * left).sum(axis=0)
            at = int(fits[score.argmin()])
        if at < 0:
            at = n_open
            room[:, at], ids[at], n_open, n_bins = 1.0, n_bins, n_open + 1, n_bins + 1
            used[ids[at]] = 0
        b = ids[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room[:, at] -= need
        if room[0, at] * limits[0] < smallest - 1e-6 or room[1, at] * limits[1] < 1 - 1e-6:
            n_open -= 1
            room[:, at], ids[at] = room[:, n_open], ids[n_open]
    return bins, offsets


#: How such a tokenizer cuts text, and what that comes to in a lower-cased word of visible ASCII.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_VISIBLE = re.compile(rb"[!-~]+")


def _cuts_so(path_json: dict) -> bool:
    """Whether visible ASCII is cut as ``_PARTS`` says and each part then goes to the model as it is."""
    steps = (path_json.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = [x["type"] for x in steps] == ["Split", "ByteLevel"] and not (steps[1]["add_prefix_space"] or steps[1].get("use_regex", True))
    normal = (path_json.get("normalizer") or {}).get("normalizers") or []
    return bool(
        plain and steps[0]["pattern"] == {"Regex": _SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"}
        and all(x["special"] for x in path_json.get("added_tokens") or [])
    )


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, remembering each word it has seen.

    The tokenizer's words never cross ASCII white space and it lower-cases, so a text's ids are its
    words' ids in a row. Words unknown so far are encoded together, those of visible ASCII by their parts, which
    recur in other words; at most ``max_words`` words, and parts, are kept.
    """

    def __init__(self, path: str, end_id: int, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end, self.max_words, self.known, self.parts = np.uint32(end_id).tobytes(), max_words, {}, {}
        with open(path, encoding="utf-8") as file:
            self.by_parts = _cuts_so(json.load(file))

    def part(self, part: str) -> bytes:
        found = self.parts[part] = np.array([x.id for x in self.tokenizer.model.tokenize(part)], "<u4").tobytes()
        return found

    def learn(self, words: Iterable[bytes]) -> None:
        known, parts, rest = self.known, self.parts, words
        if self.by_parts:
            rest = []
            for w in words:
                if _VISIBLE.fullmatch(w):
                    known[w] = b"".join([parts.get(x) or self.part(x) for x in _PARTS.findall(w.decode())])
                else:
                    rest.append(w)
        if rest:
            self.encode_words(rest)

    def encode_words(self, words: Iterable[bytes]) -> None:
        known, stems = self.known, {}
        for w in words:  # a last , or . after a plain letter is always a token of its own
            if len(w) > 1 and w[-1:] in (b".", b",") and w[-2:-1].isalpha():
                stems.setdefault(w[:-1]), stems.setdefault(w[-1:])
            else:
                stems.setdefault(w)
        new = [w for w in stems if w not in known]
        for k in range(0, len(new), 256):
            some = [w.decode("utf-8") for w in new[k : k + 256]]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(x) + 1 for x in some])
            at = np.searchsorted(np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e)), starts)
            ids = np.array(e.ids, "<u4").tobytes()
            for j, w in enumerate(new[k : k + 256]):
                known[w] = ids[4 * at[j] : 4 * at[j + 1]]
        for w in words:
            if w not in known:
                known[w] = known[w[:-1]] + known[w[-1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        for kept in (self.known, self.parts):
            if len(kept) > self.max_words:
                kept.clear()
        split = [(t or "").encode("utf-8").lower().split() for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in split]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, capacity: Capacity = Capacity(),
    id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4 << 20,
) -> DataFrame:
    """Rows (id, piece, start, length, token_ids binary, sequence_id, offset), one per piece.

    ``token_ids`` are little-endian uint32. Sequence ids are unique over the result.
    """
    kept = docs.select(F.col(id_col), valid_text(F.col(text_col)).alias(text_col))
    id_type = kept.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start bigint, length bigint, token_ids binary, sequence_id bigint, offset bigint"
    most = capacity.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_model((tokenizer_path, end_id), lambda: WordEncoder(tokenizer_path, end_id))  # keeps its words
        base, next_id = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        n_tokens, kind = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_tokens, next_id
            bins, offsets = best_fit(np.array([len(h[3]) // 4 for h in held], np.int64), capacity)
            for k in range(0, len(held), 2000):
                part = held[k : k + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[0] for h in part], kind), pa.array([h[1] for h in part], pa.int32()),
                        pa.array([h[2] for h in part], pa.int64()), pa.array([len(h[3]) // 4 for h in part], pa.int64()),
                        pa.array([h[3] for h in part], pa.binary()), pa.array(base + next_id + bins[k : k + 2000]),
                        pa.array(offsets[k : k + 2000]),
                    ],
                    names=[id_col, "piece", "start", "length", "token_ids", "sequence_id", "offset"],
                )
            next_id += int(bins.max()) + 1
            held, n_tokens = [], 0

        for batch in batches:
            kind = batch.column(0).type
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    for piece, at in enumerate(range(0, len(ids), 4 * most)):
                        held.append((doc, piece, at // 4, ids[at : at + 4 * most]))
                    n_tokens += len(ids) // 4
                    if n_tokens >= block_tokens:
                        yield from flush()
        if held:
            yield from flush()
        release()

    return kept.mapInArrow(run, schema)
