"""Sequence packing (1): vector bin packing with the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence has a
capacity in each.  With r the room left in the open sequence and x an example,
both divided by the capacities, the example with the largest product r.x among
those that fit goes in next; the room is spent where there is most of it.
Examples come from a pool of ``pool`` examples that is refilled as soon as one is
placed, while the sequence stays open, so the choice is as wide for its last
example as for its first, and a task needs bounded memory however many rows it
reads.  Of equal products the example that came first is taken.

Where examples may be cut, whole sequences are cut off long ones first, and when
nothing in the pool fits the room left, the example with the largest product is
cut to fill it.  What is left at the end of a task is cut into sequences whose
lengths are powers of two, which need no padding.

Packing runs inside each input partition, with no shuffle; a sequence id holds
the partition's number above 2^33 and a count below.  Null texts are empty (one
end id); repeated rows are packed each; an empty table gives no rows; extra
columns are ignored.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import Memo, blocks, byte_letters, texts, worker_cache

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
                "segment int, ids binary")
#: White space of Unicode and Python other than the space and line feed (fixed values).
OTHER_WHITE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words that the tokenizer's splitting rule keeps whole and never joins to what follows: letters, digits or signs.
WORDS = re.compile("( ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++|[0-9]++)(?![^\x00-\x7f])"
                   "| ?[!-&(-/:-@\\[-`{-~]++(?!'|[^\x00-\x7f]))")


class WordIds(Memo):
    """word -> ids by the tokenizer's model, read once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.bytes = tokenizer.model, byte_letters()

    def compute(self, word: str) -> bytes:
        # printable ASCII stands for itself; only the space before a word does not
        shown = word.replace(" ", self.bytes[32]) if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
        tokens = self.model.tokenize(shown)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


class PartIds(Memo):
    """part between spaces, led by head -> its ids as little-endian uint32."""

    def __init__(self, head: str, words: WordIds, encode):
        super().__init__()
        self.head, self.words, self.encode = head, words, encode

    def compute(self, part: str) -> bytes:
        found, at, whole = [], 0, self.head + part
        if WORDS.fullmatch(whole):
            return self.words.compute(whole)
        while at < len(whole) and (m := WORDS.match(whole, at)):
            found.append(self.words[m[0]])
            at = m.end()
        if at < len(whole):
            found.append(self.encode(whole[at:]))
        return b"".join(found)


class TextIds:
    """Ids of whole texts, equal to what the tokenizer gives for each at once.

    The splitting rule never joins a word to the space, line feed or word
    before it but for one leading space, so a text with plain spacing is
    looked up part by part; any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        level = self.tokenizer.pre_tokenizer
        if type(level).__name__ != "ByteLevel" or level.add_prefix_space or self.tokenizer.normalizer:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = WordIds(self.tokenizer)
        self.first, self.later = PartIds("", words, self.encode), PartIds(" ", words, self.encode)
        self.line_feed = self.encode("\n")

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if (any(s in text for s in ("  ", "\n\n", " \n", "\n ", *self.special)) or text[:1] in (" ", "\n")
                or text[-1:] in (" ", "\n") or OTHER_WHITE.search(text)):
            return self.encode(text)
        first, later, out = self.first, self.later.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head])
            out += map(later, rest)
            out.append(self.line_feed)
        return b"".join(out[:-1]) if text else b""


class Packer:
    """Packs examples (key, tokens, loss-bearing tokens) into sequences; see the module's text."""

    def __init__(self, capacity: tuple[int, int, int], cut: bool, pool: int = 256):
        self.capacity, self.cut, self.pool_size = np.array(capacity, float), cut, pool
        self.vectors = np.zeros((0, 3))
        self.items: list[tuple] = []  # (key, start, tokens, loss)
        self.fresh: list[tuple] = []
        self.sequences = 0
        self.number, self.room, self.placed = -1, self.capacity.copy(), []  # the open sequence

    def _vector(self, tokens: int, loss: int) -> list[float]:
        return [tokens, 1, loss]

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        """Placements (key, start, tokens, sequence, offset, segment) that this example makes due."""
        start, full = 0, int(self.capacity[0])
        if tokens > full or loss > self.capacity[2]:
            if not self.cut:
                raise ValueError(f"{key}: {tokens} tokens, {loss} with loss: more than a sequence holds")
            share = loss / tokens
            step = full if share * full <= self.capacity[2] else int(self.capacity[2] / share)
            while tokens >= step:
                if step == full:
                    yield key, start, step, self._next(), 0, 0
                else:
                    self.fresh.append((key, start, step, round(share * step)))
                start, tokens = start + step, tokens - step
            loss = round(share * tokens)
        if tokens:
            self.fresh.append((key, start, tokens, loss))
        while len(self.items) + len(self.fresh) >= self.pool_size:
            yield from self._step()

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _absorb(self) -> None:
        if self.fresh:
            self.vectors = np.vstack([self.vectors, [self._vector(t, x) for _, _, t, x in self.fresh]])
            self.items += self.fresh
            self.fresh = []

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], len(self.items) - 1
        self.items[i], self.vectors[i] = self.items[last], self.vectors[last]
        self.items.pop()
        self.vectors = self.vectors[:last]
        return item

    def _place(self, room: np.ndarray) -> tuple | None:
        """The next example (key, start, tokens, loss) for this room, cut if need be; None if there is none."""
        self._absorb()
        if not self.items or room.min() < 1:
            return None
        product = self.vectors @ (room / self.capacity ** 2)
        fits = (self.vectors <= room).all(axis=1)
        if fits.any():
            return self._take(int(np.argmax(np.where(fits, product, -1))))
        if not self.cut:
            return None
        key, start, whole, loss_all = self._take(int(np.argmax(product)))
        share = loss_all / whole
        tokens = int(min(room[0], whole, room[2] / share if share else whole))
        loss = min(round(share * tokens), int(room[2]), loss_all)
        if tokens < whole:
            self.fresh.append((key, start + tokens, whole - tokens, loss_all - loss))
        return (key, start, tokens, loss) if tokens else None

    def _step(self) -> Iterator[tuple]:
        """One example into the open sequence; the sequence is handed out when nothing more goes in."""
        if not self.placed:
            self.number, self.room = self._next(), self.capacity.copy()
        example = self._place(self.room)
        if example:
            self.placed.append(example)
            self.room -= self._vector(example[2], example[3])
        if not example or self.room.min() < 1:
            yield from self._close()

    def _close(self) -> Iterator[tuple]:
        offset = 0
        for segment, (key, start, tokens, _) in enumerate(self.placed):
            yield key, start, tokens, self.number, offset, segment
            offset += tokens
        self.placed = []

    def finish(self) -> Iterator[tuple]:
        """What is left; cut into powers of two where examples may be cut, the open sequence's examples among it."""
        if self.cut:
            self.fresh += self.placed
            self.placed = []
        self._absorb()
        while self.items or self.placed:
            left = int(self.vectors[:, 0].sum()) + sum(t for _, _, t, _ in self.placed)
            if self.cut and not self.placed and left < self.capacity[0]:
                self.number, self.room = self._next(), self.capacity.copy()
                self.room[0] = 1 << (left.bit_length() - 1)
                while example := self._place(self.room):
                    self.placed.append(example)
                    self.room -= self._vector(example[2], example[3])
                yield from self._close()
            else:
                yield from self._step()
            self._absorb()


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, max_segments: int | None = None,
                   max_loss: int | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their ids and places; every token but none else bears loss.

    By default as many segments as tokens are allowed, so that short texts fill a sequence, too.
    """
    capacity = (max_tokens, max_segments or max_tokens, max_loss or max_tokens)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        cache = worker_cache("text_ids")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = TextIds(tokenizer_path)
        encode = cache[tokenizer_path]
        base = TaskContext.get().partitionId() << 33
        packer, held, number, rows = Packer(capacity, cut=True), {}, 0, []

        def emit(placed):
            for key, start, length, sequence, offset, segment in placed:
                doc_id, ids, left = held[key]
                piece = ids[4 * start:4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(piece), len(ids) // 4, base + sequence, offset, segment, piece))
                if left > length:
                    held[key] = (doc_id, ids, left - length)
                else:
                    del held[key]

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 7 + [pa.int32(), pa.binary()])],
                [f.split()[0] for f in PIECE_SCHEMA.split(", ")])
            rows.clear()
            return batch

        for keys, data in blocks(batches):
            for (doc_id,), text in zip(keys, data):
                ids = encode(text.decode("utf-8", "replace")) + end
                held[number] = (doc_id, ids, len(ids) // 4)
                emit(packer.add(number, len(ids) // 4, len(ids) // 4))
                number += 1
            if rows:
                yield flush()
        emit(packer.finish())
        if rows:
            yield flush()

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, PIECE_SCHEMA)


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """Places whole instruction examples (example_id, tokens, loss_tokens) under the three limits.

    An example that no sequence can hold is returned with a null sequence_id;
    null counts count as 0.
    """
    schema = "example_id long, sequence_id long, offset long, segment int"
    capacity = (max_tokens, max_segments, max_loss)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 33
        packer = Packer(capacity, cut=False)

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.int32()])],
                ["example_id", "sequence_id", "offset", "segment"])

        for batch in batches:
            rows = []
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens > max_tokens or loss > max_loss:
                    rows.append((key, None, None, None))
                elif not tokens:
                    rows.append((key, base + packer._next(), 0, 0))
                else:
                    rows += [(k, base + s, o, g) for k, _, _, s, o, g in packer.add(key, tokens, loss)]
            yield out(rows)
        yield out([(k, base + s, o, g) for k, _, _, s, o, g in packer.finish()])

    return examples.select(F.col("example_id").cast("long"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)),
                           F.coalesce(F.col("loss_tokens").cast("long"), F.lit(0))).mapInArrow(run, schema)
