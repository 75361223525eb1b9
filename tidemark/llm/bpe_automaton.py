"""BPE as a deterministic automaton over tokens.

A merge list is compiled by adding one *merge gadget* per merge, in rank order. The automaton
starts with one state that loops on every byte. The gadget of merge ``(u, v)`` takes the state
that every ``u`` arc enters, gives ``u`` a copy of it that lacks the ``v`` arc, and adds an arc
``uv`` beside each ``u`` arc, entering the state that ``v`` entered. What the automaton then
accepts are exactly the token sequences the merges produce, so a pre-split word has one
accepting path. All arcs with one label enter one state, hence a state per label suffices.

Full rows (states x labels) would hold over 10^9 cells, nearly all of them arcs. The compiler
keeps the gadgets' log (who was copied from whom and when, what was removed and when) and
fills cells of the transition table when they are first asked for, as lazy automata do.

Labels span several bytes, so encoding a word walks its bytes with a prefix table of the labels,
tries the arcs that end at each byte, longest first, and steps back from states without one;
the accepting path is unique, so the first that is found is the answer. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.latin import LETTERS, NUMBERS, SPACES, is_plain
from tidemark.llm.shared import id_text

_NEVER = 1 << 60
#: Characters with the Unicode property White_Space.
WHITE_SPACE = "".join(f"\\u{c:04x}" for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: The split that byte-level BPE vocabularies of this kind state in their files (fixed value).
PRE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)

#: The same split of plain Latin texts, words first as they are the most frequent.
LATIN_SPLIT = (
    rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+"
    rf"| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)

def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes, in order, for the code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeAutomaton:
    """``labels[t]`` is the bytes of token t; ``merges`` are (left, right, merged) token ids."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.token = {b: t for t, b in labels.items()}
        #: Every prefix of a label, with the token it is, or -1.
        self.steps = {b[:k]: -1 for b in self.token for k in range(1, len(b) + 1)} | self.token
        self._parent = [-1]
        self._born = [-1]
        self._removed: list[dict[int, int]] = [{}]
        self._made: dict[int, tuple[int, int]] = {}
        merged = {m for _, _, m in merges}
        self.enters = {t: 0 for t in labels if t not in merged}
        entering = [len(self.enters) + 1]  # arcs' labels that enter a state; the start counts too
        for rank, (u, v, uv) in enumerate(merges):
            if u not in self.enters or v not in self.enters or uv in self.enters:
                continue
            q = self.enters[u]
            if not self._has(q, v, rank - 1):
                continue  # no path reads u then v, so the merge never happens
            self.enters[uv] = self.enters[v]
            entering[self.enters[v]] += 1
            if entering[q] > 1:
                entering[q] -= 1
                self._parent.append(q)
                self._born.append(rank)
                self._removed.append({})
                entering.append(1)
                self.enters[u] = q = len(entering) - 1
            self._removed[q][v] = rank
            self._made[uv] = (rank, u)
        self._table: dict[int, bool] = {}

    @property
    def states(self) -> int:
        return len(self._parent)

    def _has(self, q: int, t: int, at: int) -> bool:
        """Whether state q had an arc t once the gadgets up to rank ``at`` were in place."""
        while True:
            if self._removed[q].get(t, _NEVER) <= at:
                return False
            rank, left = self._made.get(t, (-1, -1))
            if rank > at:
                return False
            if rank < self._born[q]:  # an arc that the copy took over
                at, q = self._born[q] - 1, self._parent[q]
            elif rank < 0:
                return True
            else:
                at, t = rank, left

    def arc(self, q: int, t: int) -> bool:
        key = q << 32 | t
        found = self._table.get(key)
        if found is None:
            if len(self._table) > 500_000:
                self._table.clear()
            found = self._table[key] = t in self.enters and self._has(q, t, _NEVER - 1)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids on the one accepting path of a pre-split word.

        Longest arcs are tried first. A prefix has one path, so a position that leads nowhere is
        never tried again and the search stays linear in the word.
        """
        steps, arc, enters = self.steps, self.arc, self.enters
        n, i, q = len(word), 0, 0
        ids: list[int] = []
        todo: list[list[tuple[int, int]]] = []  # by depth: (end, token) still to try, the longest last
        dead: set[int] = set()
        while i < n:
            options, j = [], i + 1
            while j <= n and (t := steps.get(word[i:j])) is not None:
                if t >= 0:
                    options.append((j, t))
                j += 1
            todo.append(options)
            while True:
                options = todo[-1]
                while options:
                    j, t = options.pop()
                    if j not in dead and arc(q, t):
                        break
                else:
                    todo.pop()
                    if not todo:
                        raise ValueError("the vocabulary lacks a byte")
                    dead.add(i)
                    i -= len(self.labels[ids.pop()])
                    q = enters[ids[-1]] if ids else 0
                    continue
                ids.append(t)
                i, q = j, enters[t]
                break
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.labels[t] for t in ids])


class ByteBpe:
    """A byte-level vocabulary file (tokenizers' JSON) as an automaton plus its special strings.

    The merges' results for a word are remembered in two generations of at most ``memory`` words
    each: when the younger is full it takes the place of the older, from which words in use come
    back. Memory stays bounded on any corpus.
    """

    def __init__(self, path: str, memory: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        labels = {t: bytes(alphabet[c] for c in s) for s, t in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_text = {t: s for s, t in self.special.items()}
        self._split, self._latin = regex.compile(PRE_SPLIT), re.compile(LATIN_SPLIT)
        some = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, some)) + ")") if some else None
        self._memory, self._older, self._most = {}, {}, memory

    def _learn(self, words: list[str]) -> None:
        if len(self._memory) >= self._most:
            self._older, self._memory = self._memory, {}
        encode, decode, memory, older = self.automaton.encode, self.automaton.decode, self._memory, self._older
        for w in set(words):
            if w not in memory:
                known = older.get(w)
                if known is None:
                    ids = encode(w.encode("utf-8"))
                    known = (",".join(map(str, ids)), decode(ids))
                memory[w] = known

    def digest_parts(self, text: str) -> tuple[str, bytes]:
        """The ids as decimal text joined by commas, and the bytes that decoding them emits."""
        parts = self._specials.split(text) if self._specials and any(s in text for s in self.special) else [text]
        found: list[tuple[str, bytes]] = []
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part.encode("utf-8")))
                continue
            words = (self._latin if is_plain(part) else self._split).findall(part)
            memory = self._memory
            try:
                known = [memory[w] for w in words]
            except KeyError:
                self._learn(words)
                memory = self._memory
                known = [memory[w] for w in words]
            found += known
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        joined = self.digest_parts(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        """Emit the labels of ``ids``; special ids give their strings. Bytes that are no UTF-8 become U+FFFD."""
        out = [self.special_text[t].encode() if t in self.special_text else self.automaton.labels[t] for t in ids]
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One compiled vocabulary per Python worker."""
    return ByteBpe(path)


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text; null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, without shuffle.

    Null and empty texts have no tokens: n_tokens 0 and both digests those of no bytes. Rows
    that repeat stay repeated, as the operator looks at one row at a time; columns beside
    the two named are dropped, whatever they are called. A null id stays null.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for text in b.column(1):
                joined, decoded = bpe.digest_parts(text.as_py())
                n.append(joined.count(",") + 1 if joined else 0)
                ids_hex.append(sha256(joined.encode()).hexdigest())
                text_hex.append(sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
