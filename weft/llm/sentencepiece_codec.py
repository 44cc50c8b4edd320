"""Encoding to and decoding from the pieces of a SentencePiece model, by streaming Viterbi.

Positions of the text are nodes of a lattice, pieces its edges.  Every node
keeps its best path's last piece; only nodes within the longest piece of the
head can still be left by an edge, so when the paths of all of them pass one
boundary, the ids up to it are committed and their nodes dropped.  The window
kept is bounded by the text between two such boundaries, not by its length.

What makes a path best depends on the model's type:

* unigram: the greatest sum of the pieces' scores;
* BPE: the path that merging yields.  It is the only path all of whose
  neighbouring pieces stay as they are when their two are merged alone, so a
  path is extended by the (only) piece that its last piece can stand before.

Blanks and characters that no piece contains bound the pieces of usual models;
so do places between two characters that stand together in no piece.  The runs
between are encoded once and remembered, for a bounded number of runs.  Characters without a piece become byte pieces.

Edge cases: null and empty texts have no ids and decode to the empty text;
U+2581 in a text decodes to a blank, as the format has it; every other text
comes back byte by byte; repeated rows encode alike.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._ship import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
MEMO, LONG_RUN = 400_000, 64
START, NONE = -1, -2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            if data[i] < 128:
                return value, i + 1
            i, shift = i + 1, shift + 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Codec:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, prefix, squeeze, charsmap = UNIGRAM, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                n = dict(_fields(value))
                prefix, squeeze, charsmap = n.get(3, 1), n.get(4, 1), n.get(2, b"")
        if self.kind not in (UNIGRAM, BPE) or squeeze or charsmap or not prefix:
            raise ValueError("only unigram and BPE models that keep texts as they are and add a blank in front are read")
        self.id_of = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.score = {p: self.pieces[i][1] for p, i in self.id_of.items()}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.id_of))
        self.text_of = [
            bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(BLANK, " ").encode() if t in (NORMAL, USER) else b""
            for p, _, t in self.pieces
        ]
        self.is_byte = np.array([t == BYTE for _, _, t in self.pieces])
        single = sorted(ord(p) for p in self.id_of if len(p) == 1 and p != BLANK)
        known = "".join(f"\\U{c:08x}" for c in single)
        apart = not any(BLANK in p.lstrip(BLANK) for p in self.id_of)
        self.runs = re.compile(f"{BLANK}*[{known}]+|{BLANK}+|." if apart else f"[{BLANK}{known}]+|.", re.DOTALL)
        self.meets = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}  # neighbours within some piece
        self.memo: dict[str, bytes] = {}  # runs met lately, and those before them
        self.older: dict[str, bytes] = {}
        self.trie: dict = {}  # by character; "" holds a piece's id
        for p, i in self.id_of.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.stays: dict[int, bool] = {}

    def merged(self, s: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours are joined first, the left of equal ones."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.score.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay(self, key: int, before: int, piece: int) -> bool:
        if len(self.stays) >= MEMO:
            self.stays.clear()
        want = [self.pieces[k][0] for k in (before, piece) if k >= 0]
        got = self.stays[key] = self.merged("".join(want)) == want
        return got

    def viterbi(self, s: str) -> list[int]:
        """Ids of a run of known characters."""
        n, longest, bpe = len(s), self.longest, self.kind == BPE
        trie, stays, pieces = self.trie, self.stays.get, self.pieces
        ids: list[int] = []
        base = j = 0  # the committed boundary; the node whose edges are followed, counted from there
        room = min(n, 4 * longest) + longest
        last, back, total = [START] + [NONE] * room, [0] * (room + 1), [0.0] * (room + 1)
        # each node's last piece, where it begins, the path's score
        while base + j < n:
            if j + longest >= len(last):
                last += [NONE] * room
                back += [0] * room
                total += [0.0] * room
            before = last[j]
            if before != NONE:
                node, to = trie, j
                for c in s[base + j : base + j + longest]:
                    node = node.get(c)
                    if node is None:
                        break
                    to += 1
                    p = node.get("")
                    if p is None:
                        continue
                    if not bpe:
                        value = total[j] + pieces[p][1]
                        if last[to] == NONE or value > total[to]:
                            last[to], back[to], total[to] = p, j, value
                    elif last[to] == NONE:
                        key = (before + 1 << 20) | p
                        good = stays(key)
                        if self._stay(key, before, p) if good is None else good:
                            last[to], back[to] = p, j
            j += 1
            if j % (4 * longest) == 0 and base + j < n:
                cut = self._converged(last, back, j)
                if cut:
                    ids += self._path(last, back, cut)
                    last, back, total = last[cut:], [x - cut for x in back[cut:]], total[cut:]
                    base, j = base + cut, j - cut
        return ids + self._path(last, back, n - base)

    @staticmethod
    def _converged(last: list[int], back: list[int], j: int) -> int:
        """The last boundary that the paths of all nodes from ``j`` on have in common."""
        open_ = {k for k in range(j, len(last)) if last[k] != NONE}
        while len(open_) > 1:
            k = max(open_)
            open_.remove(k)
            open_.add(back[k])
        return open_.pop() if open_ else 0

    @staticmethod
    def _path(last: list[int], back: list[int], end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end])
            end = back[end]
        return path[::-1]

    def _run(self, run: str) -> bytes:
        packed = self.older.get(run)
        if packed is None:
            packed = self._parts(run) if run[0] in self.score else array("i", [self.byte_id[b] for b in run.encode()]).tobytes()
        if len(run) <= LONG_RUN:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[run] = packed
        return packed

    def _parts(self, run: str) -> bytes:
        """The run cut between characters that stand together in no piece; its parts may be known."""
        meets, out, at = self.meets, [], 0
        for k in range(1, len(run)):
            if run[k - 1 : k + 1] not in meets:
                part = run[at:k]
                out.append(self.memo.get(part) or self._run(part))
                at = k
        if at:
            part = run[at:]
            out.append(self.memo.get(part) or self._run(part))
            return b"".join(out)
        return array("i", self.viterbi(run)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, run = self.memo.get, self._run
        runs = self.runs.findall(BLANK + text.replace(" ", BLANK))
        return np.frombuffer(b"".join([known(r) or run(r) for r in runs]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(model: bytes, rows: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                texts = [x.as_py() or "" for x in b.column("text")]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(x) == t.replace(BLANK, " ").encode() for x, t in zip(ids, texts, strict=True)]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                off = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), lists, pa.array(same, pa.bool_())],
                    names=["doc_id", "n_ids", "ids", "round_trip"],
                )

    return run


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): round_trip tells that decoding the ids gave the text back."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in batches:
            texts = [codec.decode(np.array(x.as_py() or [], np.int32)).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
