"""Byte-pair encoding without merging: one token per prefix.

For every prefix of a piece the exact encoding ends in one token. It is the
longest token that is a suffix of the prefix and is compatible with the last
token of the prefix before it: joined, the two would not have been split in
another way. An Aho-Corasick automaton over the vocabulary yields the suffixes;
back-pointers give the ids. The time is linear in the length of the piece times
the number of suffix matches, so a piece of a million letters is no trouble.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.shared import once, share, slices

#: Fixed value: the published split pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker keeps before it starts afresh.
KEPT_PIECES = 600_000
KEPT_PAIRS = 400_000
KEPT_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes the 256 bytes:
    printable Latin-1 characters stand for themselves, the others, in order,
    for the code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary as the JSON of the tokenizers library."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)
        letters = byte_letters()
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        # Tokens are compared by rank: single bytes first, then merges in order.
        self.merged, self.halves, self.rank, self.id_of_rank = {}, {}, {}, []
        for token, i in vocab.items():
            if len(token) == 1 and token in letters:
                self.rank[token] = len(self.id_of_rank)
                self.id_of_rank.append(i)
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left + right in vocab and left + right not in self.rank:
                r = self.rank[left + right] = len(self.id_of_rank)
                self.id_of_rank.append(vocab[left + right])
                pair = (self.rank[left], self.rank[right])
                self.merged[pair] = r
                self.halves[r] = pair
        self.suffixes = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.suffixes.add_word("".join(chr(letters[c]) for c in token), (len(token), r))
        self.suffixes.make_automaton()
        self.split = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.packed = [np.array([i], "<u4").tobytes() for i in self.id_of_rank]
        self.rank_of_byte = {letters[t]: r for t, r in self.rank.items() if t in letters}
        self.known: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges of ``left`` and ``right`` side by side leave them
        as they are: undo the latest merge first, and look at each step whether
        the pair at the seam would have been merged before it."""
        merged, halves = self.merged, self.halves
        limit = len(self.id_of_rank)
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left not in halves:
                    return True
                limit, left = left, halves[left][1]
            else:
                if right not in halves:
                    if left not in halves:
                        return True
                    limit, left = left, halves[left][1]
                else:
                    limit, right = right + 1, halves[right][0]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        n = len(data)
        if n == 1:
            return self.packed[self.rank_of_byte[ord(data)]]
        last, size, done, known = [-1] * (n + 1), [0] * (n + 1), -1, self.known
        for end, (length, rank) in self.suffixes.iter(data):
            if end == done:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                fits = known.get((left, rank))
                if fits is None:
                    if len(known) >= KEPT_PAIRS:
                        known.clear()
                    fits = known[left, rank] = self._compatible(left, rank)
                if not fits:
                    continue
            last[end], size[end], done = rank, length, end
        out, at, packed = [], n - 1, self.packed
        while at >= 0:
            out.append(packed[last[at]])
            at -= size[at]
        return b"".join(out[::-1])

    def _pieces(self, text: str) -> bytes:
        """The split pieces of a text, from the kept ones where possible."""
        out, kept, new = [], self.kept, False
        for piece in self.split.findall(text):
            found = kept.get(piece)
            if found is None:
                new, found = True, self.encode_piece(piece)
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = found
            out.append(found)
        found = b"".join(out)
        if not new and len(text) <= KEPT_CHARS:
            kept[text] = found
        return found

    def _plain(self, text: str) -> bytes:
        if _ADJACENT.search(text):
            return self._pieces(text)
        # With single spaces only, no piece goes on across one: the text can be
        # cut before each, and common words need no splitting.
        first, *rest = text.split(" ")
        out, kept, pieces = [self._pieces(first)], self.kept, self._pieces
        for word in rest:
            word = " " + word
            out.append(kept.get(word) or pieces(word))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for match in self.cut.finditer(text):
            out += [self._plain(text[at : match.start()]), np.array([self.special[match.group()]], "<u4").tobytes()]
            at = match.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ADJACENT = regex.compile(r"\s\s")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, n_tokens,
    ids (binary: little-endian unsigned 32-bit integers), decoded.

    The ids are those of the tokenizers library without added special tokens;
    the strings of special tokens in a text become their ids. Null and empty
    texts have no tokens. Repeated rows stay; no rows give no rows. The file
    is read on the driver and sent to the tasks; its size is the vocabulary's.
    No shuffle."""
    with open(tokenizer_path, encoding="utf-8") as file:
        held = share(docs.sparkSession, file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(held, Vocabulary)
        for batch in slices(batches, limit=1 << 21):
            ids = [model.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([model.decode(i) for i in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string")
