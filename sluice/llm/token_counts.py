"""Token counts by finite-state transducers.

Two deterministic machines, both compiled from the tokenizer's own file:

* Segmentation: six states over ten character classes find where pre-tokenised words begin. A text is cut into
  chunks of equal length; each chunk is run from all six entry states at once and so becomes a map from entry
  state to exit state. Such maps compose associatively, so a parallel prefix scan (log2 of the number of chunks
  steps) gives each chunk's true entry state, and a second run marks the word starts.
* Merging: byte-pair encoding as a transducer over bytes. After any prefix, the last token of its encoding is the
  only vocabulary token ending there that may follow the last token before it. A state therefore keeps the
  unfinished vocabulary paths that end at this byte, each with the token before it and how many tokens were
  emitted since. A transition is annotated with the number of tokens it adds. States are compiled when first
  reached and kept in dense tables, over which all words of a batch step together.

The merging machine is in its first state at every word's begin, whatever came before. So its map over a stretch that
begins with a word is known from one entry state, the maps of chunks that consist of whole words compose by adding
their counts, and words are the chunks that step side by side; only the segmentation, which crosses any cut, needs
maps from all of its states and their scan. Texts of more than PART bytes are cut at white space, where both start anew.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import parts, sliced, texts
from .tokens import WORD_BPE, byte_characters

# Character classes: white space, number, other, apostrophe, letter, the letters s t m d, r v, e, l.
SPACE, NUMBER, OTHER, QUOTE, LETTER, ONE, TWO, E, L = range(9)
# Segmentation states: outside words; in a run of letters; of others; after an apostrophe that may start a
# contraction; after '  and r or v; after ' and l.
OUT, LETTERS, OTHERS, QUOTED, EXPECT_E, EXPECT_L = range(6)
#: What a transition marks: nothing, a word starting here, one at the character before, both.
HERE, BEFORE = 1, 2
#: Bytes of one text that are counted at once.
PART = 1 << 20


def segmentation() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and mark[state, class] for 's|'t|'re|'ve|'m|'ll|'d|letters|number|others."""
    to, mark = np.zeros((6, 9), np.uint8), np.zeros((6, 9), np.uint8)

    def plain(state: int, c: int) -> tuple[int, int]:
        if c == SPACE:
            return OUT, 0
        if c == NUMBER:
            return OUT, HERE
        if c in (OTHER, QUOTE):
            return (OTHERS, 0) if state == OTHERS else (QUOTED if c == QUOTE else OTHERS, HERE)
        return LETTERS, 0 if state == LETTERS else HERE

    for c in range(9):
        for state in (OUT, LETTERS, OTHERS):
            to[state, c], mark[state, c] = plain(state, c)
        if c == ONE:
            to[QUOTED, c] = OUT
        elif c in (TWO, L):
            to[QUOTED, c] = EXPECT_E if c == TWO else EXPECT_L
        else:
            to[QUOTED, c], mark[QUOTED, c] = plain(OTHERS, c)
        for state, wanted in ((EXPECT_E, E), (EXPECT_L, L)):
            if c == wanted:
                to[state, c] = OUT
            else:  # the apostrophe stood alone, and the letter after it began a word
                after, at = plain(LETTERS, c)
                to[state, c], mark[state, c] = after, at | BEFORE
    return to, mark


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point below 0x3000; others are looked up when met."""
    return np.array([_class(chr(i)) for i in range(0x3000)], np.uint8)


@functools.lru_cache(100_000)
def _class(c: str) -> int:
    if regex.match(r"\s", c):
        return SPACE
    if c == "'":
        return QUOTE
    if regex.match(r"\p{L}", c):
        return ONE if c in "stmd" else TWO if c in "rv" else E if c == "e" else L if c == "l" else LETTER
    return NUMBER if regex.match(r"\p{N}", c) else OTHER


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps in sequence: compose(f, g)[i] = g[f[i]], for rows of maps."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """For each row, the composition of it and all rows before it, in log2(n) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def word_starts(kinds: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Where words start, as booleans, in a text given by its character classes. The text must end in white space."""
    to, mark = _SEGMENTATION
    n = len(kinds)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, SPACE, np.uint8)
    padded[:n] = kinds
    lanes = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    state = np.tile(np.arange(6, dtype=np.intp), (rows, 1))
    flat = to.astype(np.intp).ravel()
    for column in lanes:
        state = flat[state * 9 + column[:, None]]
    entry = np.zeros(rows, np.intp)
    if rows > 1:
        entry[1:] = prefix_scan(state)[:-1, OUT]
    marks, flat_mark = np.zeros((chunk, rows), np.uint8), mark.ravel()
    for k, column in enumerate(lanes):
        at = entry * 9 + column
        marks[k] = flat_mark[at]
        entry = flat[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


_SEGMENTATION = segmentation()


class MergeTransducer:
    """Byte-pair encoding with word ends as a transducer whose transitions say how many tokens they add."""

    def __init__(self, rules: dict, most_states: int = 250_000):
        self.most_states = most_states
        of = {c: b for b, c in byte_characters().items()}
        end = rules["model"]["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            bare = token.removesuffix(end)
            out = [of[c] for c in bare]
            if len(bare) != len(token):
                out[-1] += 256
            return tuple(out)

        self.rank, self.parts = {}, []
        self.tree: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        known: dict[tuple[int, ...], int] = {}
        self.single: dict[int, int] = {}
        for b in range(512):
            self.single[b] = self._add(known, (b,))
        for rank, pair in enumerate(rules["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = known[symbols(left)], known[symbols(right)]
            self.rank.setdefault((a, b), (rank, self._add(known, symbols(left) + symbols(right))))
        self.fit: dict[tuple[int, int], bool] = {}
        self.reset()

    def _add(self, known: dict, symbols: tuple[int, ...]) -> int:
        if symbols not in known:
            known[symbols] = len(self.parts)
            self.parts.append(symbols)
            node = 0
            for s in symbols:
                if s not in self.tree[node]:
                    self.tree[node][s] = len(self.tree)
                    self.tree.append({})
                    self.token_at.append(-1)
                node = self.tree[node][s]
            self.token_at[node] = known[symbols]
        return known[symbols]

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """By the definition: the merge of lowest rank first, the leftmost of equal ones."""
        out = [self.single[s] for s in symbols]
        while len(out) > 1:
            best, at = min((self.rank.get(p, (1 << 30, 0))[0], k) for k, p in enumerate(zip(out, out[1:])))
            if best == 1 << 30:
                break
            out[at : at + 2] = [self.rank[out[at], out[at + 1]][1]]
        return out

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joint bytes."""
        key = (before, token)
        if key not in self.fit:
            self.fit[key] = self.encode(self.parts[before] + self.parts[token]) == [before, token]
        return self.fit[key]

    def reset(self) -> None:
        """Forget the compiled states; bounds the tables' memory."""
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.column = np.full(256, -1, np.int64)
        self.bytes: list[int] = []
        self.to = np.full((1024, 64), -1, np.int32)
        self.adds = np.zeros((1024, 64), np.int8)
        self.last = np.full((1024, 64), -128, np.int8)
        self._number(((0, -1, 0),))
        if len(self.fit) > 2_000_000:
            self.fit.clear()

    def _number(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.to):
                self._grow(2 * len(self.to), self.to.shape[1])
        return self.number[state]

    def _grow(self, rows: int, columns: int) -> None:
        for name, empty in (("to", -1), ("adds", 0), ("last", -128)):
            old = getattr(self, name)
            new = np.full((rows, columns), empty, old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The tables' columns of some bytes; a byte that is new gets the next free one."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0)):
            self.column[b] = len(self.bytes)
            self.bytes.append(int(b))
            if len(self.bytes) > self.to.shape[1]:
                self._grow(self.to.shape[0], 2 * self.to.shape[1])
        return self.column[data]

    def _step(self, state: tuple, symbol: int) -> tuple[int, int, list]:
        """The token that ends with this symbol, the tokens added, and the paths that go on."""
        chosen, added, paths = -1, 0, []
        for node, before, since in state:
            child = self.tree[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if chosen < 0 and token >= 0 and (before < 0 or self.fits(before, token)):
                chosen, added = token, 1 - since
            if self.tree[child]:
                paths.append((child, before, since))
        if chosen < 0:
            raise ValueError("no token of the vocabulary ends here")
        return chosen, added, paths

    def compile(self, state: int, column: int, final: bool) -> None:
        byte = self.bytes[column]
        if final:
            self.last[state, column] = self._step(self.states[state], byte + 256)[1]
        else:
            token, added, paths = self._step(self.states[state], byte)
            after = self._number((*((node, before, since + added) for node, before, since in paths), (0, token, 0)))
            self.to[state, column], self.adds[state, column] = after, added

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word, given as places in the bytes of a text. All words step together."""
        if len(self.states) > self.most_states:
            self.reset()
        order = np.argsort(-length, kind="stable")
        start, length, code = start[order], length[order], self.columns(data)
        found, state, live, k = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), len(start), 0
        while live:
            go = int(np.searchsorted(-length[:live], -(k + 1), "left"))  # longer than k+1 bytes: they go on
            symbol = code[start[:live] + k]
            here, tail = (state[:go], symbol[:go]), (state[go:live], symbol[go:live])
            self._ensure(*tail, True)
            found[go:live] += self.last[tail]
            self._ensure(*here, False)
            found[:go] += self.adds[here]
            state[:go] = self.to[here]
            live, k = go, k + 1
        out = np.empty_like(found)
        out[order] = found
        return out

    def _ensure(self, state: np.ndarray, symbol: np.ndarray, final: bool) -> None:
        unknown = self.last[state, symbol] == -128 if final else self.to[state, symbol] < 0
        if unknown.any():
            for s, c in set(zip(state[unknown].tolist(), symbol[unknown].tolist())):
                self.compile(s, c, final)


class Counter:
    """counts(texts) as the tokenizers library counts, for vocabularies like word_bpe_49k.json."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        rules = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.special = [x["content"] for x in rules["added_tokens"]]
        self.transducer = MergeTransducer(rules)

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if max(text) < "ɐ" and "İ" not in text:  # these are stable under NFC, and lower-cased one by one
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def long(self, doc: bytes, part: int = PART) -> np.ndarray:
        """The count of one text, part by part."""
        return np.array([sum(int(self.counts([p.decode()])[0]) for p in parts(doc, limit=part))], np.int64)

    def counts(self, docs: list[str]) -> np.ndarray:
        plain = ["" if any(x in t for x in self.special) else self._normal(t) for t in docs]
        joined = " ".join(plain) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        table = classes()
        kinds = table[np.minimum(points, len(table) - 1)]
        for at in np.flatnonzero(points >= len(table)):
            kinds[at] = _class(chr(points[at]))
        starts = np.flatnonzero(word_starts(kinds))
        # a word ends where the next one or white space begins
        space = np.flatnonzero(kinds == SPACE)
        ends = np.minimum(np.append(starts[1:], len(points)), space[np.searchsorted(space, starts)]) if len(starts) else starts
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width)))
        data = np.frombuffer(joined.encode(), np.uint8)
        tokens = self.transducer.counts(data, offset[starts], offset[ends] - offset[starts])
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in plain])))
        out = np.bincount(np.searchsorted(base, starts, "right") - 1, tokens, len(docs)).astype(np.int64)
        for k, t in enumerate(docs):
            if any(x in t for x in self.special):
                out[k] = len(self.library.encode(t, add_special_tokens=False).ids)
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str = WORD_BPE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, a row for each row of docs, without a shuffle.

    vocabulary: a name that public_tokenizers knows, or a path that all executors can open. A null text counts as
    empty: 0 bytes, 0 tokens. A null doc_id stays null. Repeated rows give repeated rows. Other columns are ignored.
    Special strings inside texts count as the library's default has them (one token each). An empty table gives no rows.
    """

    def run(batches):
        count = counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        for batch in sliced(batches, limit=PART):
            docs = [t.encode() for t in texts(batch)]
            n = count.long(docs[0]) if len(docs) == 1 else count.counts([t.decode() for t in docs])
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in docs], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
