"""Token counts (5): finite-state compilation of a word-level BPE tokenizer.

The tokenizer's splitting rule is compiled into a deterministic transducer over
character classes.  A transition may emit the start of a word, at this
character or at the one before it (an apostrophe that turns out not to begin a
contraction).  Texts are cut into chunks of equal length; every chunk is run
from all states at once, which gives its state map (entry state -> exit state);
the maps are composed by a parallel prefix scan, and the scan's result fixes
the state at every character, hence every word.

The merges are compiled into a second transducer over the symbols of a word
(bytes, the last one marked).  The encoding of a prefix is fixed by its last
token, as two tokens may stand side by side exactly if no merge across their
border fires before the merges that build them.  A state holds, for every place
from which a token may still be running, the node of the token trie, the last
token before that place and how many tokens fewer there were; a transition is
annotated with the tokens that its symbol adds to the encoding so far, less
those that it takes back by joining them.  States are finite in number and are
built when they are first reached; beyond CACHE_STATES they are built anew.  The
library is not asked for any count.

Supported: a BPE model with Split by the contraction pattern below, then
ByteLevel, whose merges each make a token of their own from earlier ones.
``Counter`` refuses any other tokenizer file.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
an empty table gives no rows; extra columns are ignored.  Very long texts are
scanned whole, chunk by chunk.
"""
from __future__ import annotations

import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import CACHE_WORDS, blocks, byte_letters, texts, worker_cache

#: The splitting pattern that the state machine below implements (fixed value of the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, SYMBOL, QUOTE = range(5)
#: White_Space of Unicode (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
START_HERE, START_BEFORE = 1, 2
#: States of the merge transducer that a worker keeps; symbols of a word: a byte, or a last byte.
CACHE_STATES, SYMBOLS = 1 << 17, 512
#: Characters of a chunk, and characters that one step of the scan holds.
CHUNK, STEP = 256, 1 << 20


def char_classes() -> np.ndarray:
    """Class of every code point: the five above; letters that occur in contractions get classes of their own."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else DIGIT
    out[WHITE] = SPACE
    out[ord("'")] = QUOTE
    for k, c in enumerate(sorted(set("".join(CONTRACTIONS)))):
        out[ord(c)] = 5 + k
    return out


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted starts) by class and state.

    States: 0 between words, 1 in letters, 2 in symbols, 3 after a lone
    apostrophe, then one for each unfinished two-letter contraction.
    """
    letters = sorted(set("".join(CONTRACTIONS)))
    heads = sorted({c[0] for c in CONTRACTIONS if len(c) == 2})
    n_states, n_classes = 4 + len(heads), 5 + len(letters)
    nxt, emit = np.zeros((n_classes, n_states), np.uint8), np.zeros((n_classes, n_states), np.uint8)
    for k in range(n_classes):
        char = letters[k - 5] if k >= 5 else None
        kind = LETTER if char else k
        for state in range(n_states):
            head = heads[state - 4] if state >= 4 else None
            late = START_BEFORE if head else 0  # the pending letter begins a word of its own
            if kind == SPACE:
                to, what = 0, late
            elif kind == DIGIT:
                to, what = 0, late | START_HERE
            elif kind in (SYMBOL, QUOTE):
                if state in (2, 3):
                    to, what = 2, 0
                else:
                    to, what = (3 if kind == QUOTE else 2), late | START_HERE
            elif head:
                to, what = (0, 0) if char and head + char in CONTRACTIONS else (1, late)
            elif state == 3 and char in CONTRACTIONS:
                to, what = 0, 0
            elif state == 3 and char in heads:
                to, what = 4 + heads.index(char), 0
            else:
                to, what = 1, 0 if state == 1 else START_HERE
            nxt[k, state], emit[k, state] = to, what
    return nxt, emit


def chunk_maps(classes: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """State maps of chunks (columns of classes): all entry states run side by side."""
    n = nxt.shape[1]
    table = nxt.ravel()
    state = np.repeat(np.arange(n, dtype=np.uint8)[:, None], classes.shape[1], axis=1)
    for row in classes.astype(np.uint8) * np.uint8(n):
        state = table.take(row + state)
    return state.T


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan under composition: row i maps an entry state through chunks 0..i (doubling steps)."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def word_starts(classes: np.ndarray, nxt: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Marks of the characters at which words begin.  The classes must end in a space."""
    n = len(classes)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)  # class 0 is the space
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    scanned = prefix_scan(chunk_maps(grid, nxt))
    state = np.zeros(rows, np.uint8)
    state[1:] = scanned[:-1, 0]  # a text begins between words
    emitted = np.empty((CHUNK, rows), np.uint8)
    for j, row in enumerate(grid * np.uint8(nxt.shape[1])):
        at = row + state
        emitted[j] = emit.ravel().take(at)
        state = nxt.ravel().take(at)
    emitted = emitted.T.ravel()
    starts = (emitted & START_HERE).astype(bool)
    starts[:-1] |= (emitted[1:] & START_BEFORE).astype(bool)
    return starts[:n]


class Merges:
    """BPE merges as a lazily determinised transducer; see the module's docstring."""

    def __init__(self, model: dict):
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError("not the kind of BPE model that is compiled here")
        names = [letters[b] for b in range(256)] + [letters[b] + end for b in range(256)]
        symbols = {name: k for k, name in enumerate(names)}  # without a suffix, last bytes are like any other
        self.last = symbols[names[256]]
        self.rank, self.parts, spelt, number = {}, {}, {}, {}
        for name, k in symbols.items():
            number[name], spelt[k] = k, (k,)
        for r, merge in enumerate(model["merges"]):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            if x not in number or y not in number or x + y in number:
                raise ValueError(f"merge {r}: parts must be made before it and its token only by it")
            t = number[x + y] = SYMBOLS + r
            self.parts[t] = pair = (number[x], number[y])
            self.rank[pair], spelt[t] = t, spelt[pair[0]] + spelt[pair[1]]
        self.trie, self.token = {}, [-1]
        for t, spelling in spelt.items():
            if t >= SYMBOLS and not self._stands(*self.parts[t], t):
                continue  # other merges always come first
            node = 0
            for k in spelling:
                key = node * SYMBOLS + k
                node = self.trie.get(key)
                if node is None:
                    node = self.trie[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = t
        self.inner = {key // SYMBOLS for key in self.trie}
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[int, int], bool] = {}
        self.chains = [((0, -1, 0),)]
        self.states = {self.chains[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """Pieces of a token at one of its ends, each with the merge (numbered by rank) that uses it up."""
        out = [(t, float("inf"))]
        while t >= SYMBOLS:
            out.append((self.parts[t][side], t))
            t = self.parts[t][side]
        return out

    def _stands(self, x: int, y: int, but: int = -1) -> bool:
        """No merge across the border of two tokens fires, one excepted; of equal merges the left one fires first."""
        right = self._edge(y, 0)
        return not any((m := self.rank.get((a, b))) is not None and m != but and m < until_a and m <= until_b
                       for a, until_a in self._edge(x, 1) for b, until_b in right)

    def _build(self, state: int, symbol: int) -> tuple[int, int]:
        running, token, added = [], -1, 0
        for node, before, fewer in self.chains[state]:
            to = self.trie.get(node * SYMBOLS + symbol)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and token < 0:
                fits = before < 0 or self.fits.get((before, t))
                if fits is None:
                    fits = self.fits[(before, t)] = self._stands(before, t)
                if fits:
                    token, added = t, fewer + 1
            if to in self.inner:
                running.append((to, before, fewer))
        chain = (*((n, b, f - added) for n, b, f in running), (0, token, 0))
        to = self.states.setdefault(chain, len(self.chains))
        if to == len(self.chains):
            self.chains.append(chain)
        self.step[state * SYMBOLS + symbol] = to, added
        return to, added

    def count(self, word: bytes) -> int:
        """Tokens of one word, which is not empty."""
        if len(self.chains) >= CACHE_STATES or len(self.fits) >= 8 * CACHE_STATES:
            self.reset()
        step, state, total = self.step, 0, 0
        for symbol in word[:-1]:
            found = step.get(state * SYMBOLS + symbol)
            state, added = found or self._build(state, symbol)
            total += added
        last = word[-1] + self.last
        return total + (step.get(state * SYMBOLS + last) or self._build(state, last))[1]


class WordCounts(dict):
    """word -> tokens emitted on its path through the merge transducer; emptied at CACHE_WORDS."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.merges.count(word.encode())
        return n


class Counter:
    """The compiled tokenizer of one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["pattern"].get("Regex") != PATTERN or level["type"] != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not the kind of tokenizer that is compiled here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.full_normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.classes, (self.next, self.emit) = char_classes(), compile_splitter()
        self.words = WordCounts(Merges(spec["model"]))

    def normalize(self, text: str) -> str:
        """NFC and lower case; the library's own where lower case depends on the neighbours (final sigma)."""
        if text.isascii():
            return text.lower()
        return self.full_normalize(text) if "\u03a3" in text else unicodedata.normalize("NFC", text).lower()

    def counts(self, texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if "<|" in text:
                for s in self.special:  # a special string is one token and parts the text
                    out[i] += text.count(s)
                    text = text.replace(s, "\n")
            held.append((i, self.normalize(text) + " " if text else " "))
            size += len(held[-1][1])
            if size >= STEP:
                self._add(held, out)
                held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: list[int]) -> None:
        if not held:
            return
        joined = "".join(t for _, t in held)
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = word_starts(classes, self.next, self.emit)
        begin = np.flatnonzero(starts)
        # a word ends where the next begins or at a space, whichever comes first
        cuts = np.flatnonzero(starts | (classes == SPACE))
        end = cuts[np.searchsorted(cuts, begin, side="right")]
        words = self.words
        n = np.fromiter([words[joined[a:b]] for a, b in zip(begin.tolist(), end.tolist())], np.int64, len(begin))
        total = np.concatenate([[0], np.cumsum(n)])
        edge = np.cumsum([len(t) for _, t in held])
        upto = total[np.searchsorted(begin, edge)]
        for (i, _), k in zip(held, np.diff(upto, prepend=0).tolist()):
            out[i] += k


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches):
        import pyarrow as pa
        cache = worker_cache("counters")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = Counter(tokenizer_path)
        counter = cache[tokenizer_path]
        for keys, data in blocks(batches):
            n = counter.counts([t.decode("utf-8", "replace") for t in data])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([len(t) for t in data], pa.int64()),
                 pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
