"""Op 9: documents into token windows by sum-of-squares online packing.

A partition's task keeps a level array: how many windows are filled to each level. A piece of s
tokens goes to the level h (0: a new window) that makes the sum of squared counts of partly filled
windows least; at equal sums to the fullest level.
Documents above a window are cut into whole windows and one rest. Full windows leave at once; at the
end of a task the emptiest open window is cut up to fill the fullest, until one is left, which becomes
windows whose sizes are powers of two, so that nothing is padded.

By this rule the number of open windows doesn't grow with the documents: on the tables here 51,282 of
them, thrice over, never had more than 210 open. Only sizes that never fit together (all above half a
window, say) would keep a window open for each document; so that a task's memory has a bound in that case
too, more than `OPEN` (a parameter) open windows are brought back to it as at the end of a task. No rows
are lost by that, and on the tables here it never happens. No shuffle.

Defined cases: null and empty texts are the closing id alone; very long texts are packed whole; repeated
rows are packed each; at equal sums of squares the fullest level wins, of its windows the one filled to it
last; a null doc_id passes through; an empty table gives an empty result; other columns are not carried,
whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, once_a_worker, slices

WINDOW, CLOSE, OPEN = 4096, 2, 1024
#: Words kept for a worker: as written, and without case and final marks.
SEEN, KNOWN, LONGEST = 300_000, 350_000, 48
FINAL_MARKS = re.compile(rb"([a-z])([.,!]+)\Z")


class Words:
    """Little-endian 32-bit ids of the words of texts, as one tokenizer gives them for whole texts.

    The tokenizer drops white space and never joins what white space parts, so words can be coded
    apart; the first ones met are kept. Lower-casing A-Z changes only the strings of special ids,
    so texts with "<|" are coded as they stand. A mark after a letter is a token run of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # Plain dicts: set.difference() looks keys up in those, and walks through any other mapping.
        self.seen: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        mark = FINAL_MARKS.search(word)
        return (word[: mark.start(2)], mark[2]) if mark else (word,)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Codes plain words (letters only, one run of tokens each) a few hundred at a time, the others one by one."""
        out = {}
        plain = [w for w in words if len(w) <= LONGEST and w.decode().isalpha()]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                continue
            whole, at = ids.tobytes(), 0
            for w, end in zip(group, (cuts * 4).tolist(), strict=True):
                out[w] = whole[at:end]
                at = end
        for w in words:
            if w not in out:
                out[w] = self.whole(w.decode())
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [None if b"<|" in t else t.lower().replace(b"\n", b" ").split(b" ") for t in texts]
        new = set()
        for words in split:
            new.update(words or ())
        new = new.difference(self.seen)
        parts = {w: self.parts(w) for w in new}
        base = {p for own in parts.values() for p in own}.difference(self.known)
        learnt = self.learn(base)
        room = max(0, KNOWN - len(self.known))
        self.known.update((w, x) for w, x in list(learnt.items())[:room] if len(w) <= LONGEST)
        self.seen.update((w, b"".join([self.known.get(p) or learnt[p] if p else b"" for p in own])) for w, own in parts.items())
        get = self.seen.__getitem__
        out = [self.whole(t.decode()) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
        for w in new:  # what is over goes again
            if len(w) > LONGEST or len(self.seen) > SEEN:
                del self.seen[w]
        return out


class Packer:
    """Sum-of-squares packing of pieces (document, start, ids) into windows; `out` gets (window, offset, piece) of closed ones."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list]] = {}
        self.closed, self.open, self.out = 0, 0, []

    def close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((self.closed, offset, piece))
            offset += len(piece[2])
        self.closed += 1

    def take(self, level: int) -> list:
        pieces = self.levels[level].pop()
        self.count[level] -= 1
        self.open -= 1
        return pieces

    def put(self, pieces: list, level: int) -> None:
        if level == self.window:
            return self.close(pieces)
        self.levels.setdefault(level, []).append(pieces)
        self.count[level] += 1
        self.open += 1
        return None

    def best_level(self, size: int) -> int:
        """The level whose use makes the sum of squares least; 0 is a new window."""
        here = self.count[1 : self.window - size + 1]
        if not len(here):
            return 0
        # Leaving level h saves 2 count[h] - 1, reaching h+s adds 2 count[h+s] + 1; a full window counts no more.
        change = 2 * (self.count[1 + size :] - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return at + 1 if change[at] <= 2 * self.count[size] + 1 else 0

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.close([(document, at, ids[at : at + self.window])])
        if size := len(ids) - whole:
            level = self.best_level(size)
            pieces = self.take(level) if level else []
            # A copy: an open window must not keep the rest of a long document.
            self.put([*pieces, (document, whole, ids[whole:].copy() if whole else ids)], level + size)
            while self.open > self.most_open:
                self.merge()

    def merge(self) -> None:
        """Cuts the emptiest open window to fill the fullest ones."""
        levels = [h for h, x in self.levels.items() if x]
        pieces = self.take(min(levels))
        while pieces and self.open:
            level = max(h for h, x in self.levels.items() if x)
            into, room = self.take(level), self.window - level
            while pieces and room:
                document, start, ids = pieces.pop()
                if len(ids) > room:
                    pieces.append((document, start, ids[: len(ids) - room]))
                    start, ids = start + len(ids) - room, ids[len(ids) - room :]
                into.append((document, start, ids))
                room -= len(ids)
            self.put(into, self.window - room)
        if pieces:
            self.put(pieces, sum(len(p[2]) for p in pieces))

    def finish(self) -> None:
        while self.open > 1:
            self.merge()
        if self.open:
            pieces = self.take(next(h for h, x in self.levels.items() if x))
            left = sum(len(p[2]) for p in pieces)
            while left:
                size = 1 << (left.bit_length() - 1)
                part, room = [], size
                while room:
                    document, start, ids = pieces.pop(0)
                    if len(ids) > room:
                        pieces.insert(0, (document, start + room, ids[room:]))
                        ids = ids[:room]
                    part.append((document, start, ids))
                    room -= len(ids)
                self.close(part)
                left -= size

    def drain(self) -> list:
        out, self.out = self.out, []
        return out


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_batches(path: str, window: int, close: int, most_open: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        words = once_a_worker(f"words {path}", lambda: Words(path))
        packer, last = Packer(window, most_open), np.array([close], "<u4").tobytes()
        task = TaskContext.get().partitionId() << 32

        def rows(kind):
            got = packer.drain()
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0][0] for _, _, p in got], kind), pa.array([p[1] for _, _, p in got], pa.int64()), pa.array([len(p[2]) for _, _, p in got], pa.int64()), pa.array([p[2].tobytes() for _, _, p in got], pa.binary()), pa.array([p[0][1] for _, _, p in got], pa.int64()), pa.array([task + w for w, _, _ in got], pa.int64()), pa.array([o for _, o, _ in got], pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        kind = None
        for batch in slices(batches, 64, ("words ",)):
            kind = batch.column(0).type
            for i, ids in zip(batch.column(0).to_pylist(), words.encode(as_bytes(batch.column(1))), strict=True):
                own = np.frombuffer(ids + last, "<u4")
                packer.add((i, len(own)), own)
            yield rows(kind)
        packer.finish()
        if kind is not None:
            yield rows(kind)

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, close: int = CLOSE, most_open: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pack_batches(tokenizer, window, close, most_open), f"doc_id {kind}, {SCHEMA}")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
