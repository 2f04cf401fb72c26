"""Token counts that follow edits: a segment tree over each document's pre-tokens, re-encoded only around an edit."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import packed, unpacked

#: The vocabulary (ranks of a byte-level BPE) and the pre-token pattern that goes with it: fixed values.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, where the classes are these.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: A pre-token depends on its own characters and this many after them at most.
REACH = 4
#: Pre-tokens of a leaf; characters after an edit that are split again at first.
LEAF, CONTEXT = 64, 16
#: Edits at most so many characters apart are one region.
NEAR = 48
CACHE = 400_000


class Counter(dict):
    """Pre-token to its number of tokens; forgets all when it holds CACHE pre-tokens."""

    def __init__(self, vocabulary: str):
        import tiktoken

        super().__init__()
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pre", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._ascii, self._any = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall

    def split(self, text: str) -> list[str]:
        """The text's pre-tokens."""
        return self._ascii(text) if text.isascii() else self._any(text)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n

    def tokens(self, pieces: list[str]) -> int:
        return sum(map(self.__getitem__, pieces))


class PretokenTree:
    """Sums of tokens and characters over a document's pre-tokens; an edit replaces the pre-tokens that it touches.

    A leaf holds LEAF pre-tokens in a row, and after edits those that took their place; inner nodes add up two nodes
    each. An edit finds its leaf by descent, changes the leaves of its region and updates their paths to the root.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.split(text)
        self.n = len(pieces)
        self.blocks = [pieces[i : i + LEAF] for i in range(0, self.n, LEAF)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = self._tree([*map(counter.tokens, self.blocks)])
        self.chars = self._tree([sum(map(len, x)) for x in self.blocks])
        self.encoded = 0

    def _tree(self, leaves: list[int]) -> list[int]:
        tree = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for node in range(self.size - 1, 0, -1):
            tree[node] = tree[2 * node] + tree[2 * node + 1]
        return tree

    @property
    def leaves(self) -> list[str]:
        return [x for block in self.blocks for x in block]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the place of it in the leaf."""
        node, chars = 1, self.chars
        while node < self.size:
            node *= 2
            if at >= chars[node] and chars[node + 1]:
                at -= chars[node]
                node += 1
        return node - self.size, at

    def _add(self, leaf: int, tokens: int, chars: int) -> None:
        node, sums, lengths = leaf + self.size, self.sums, self.chars
        while node:
            sums[node] += tokens
            lengths[node] += chars
            node >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in the place of characters start to end."""
        leaf, at = self._find(max(0, start - REACH))
        block = self.blocks[leaf]
        ends = [*accumulate(map(len, block))]
        i = bisect_right(ends, at)  # the pre-token that holds the character: none before it can change
        begin = ends[i - 1] if i else 0
        a = start - max(0, start - REACH) + at - begin
        b, more = a + end - start, CONTEXT
        while True:
            old, last = block[i:], leaf  # from here on to the end of a leaf, with enough context after the edit
            if last + 1 < len(self.blocks) and (short := b + more - self.chars[leaf + self.size] + begin) > 0:
                while short > 0 and last + 1 < len(self.blocks):
                    last += 1
                    old += self.blocks[last]
                    short -= self.chars[last + self.size]
            stop = bisect_left(ends, begin + b + more) + 1 - i if last == leaf else len(old)
            whole = stop >= len(old) and last + 1 == len(self.blocks)
            old = old[:stop]  # of a leaf only what the context asks for is split again
            k = len(old)
            limits = [*accumulate(map(len, old))]
            window = "".join(old)
            text = window[:a] + new + window[b:]
            sure = len(text) if whole else len(text) - REACH
            shift, changed = len(new) - (b - a), a + len(new)
            same = bisect_left(limits, b)
            pieces, done, found = self.counter.split(text), 0, None
            for n, piece in enumerate(pieces, 1):
                done += len(piece)
                if done > sure:
                    break  # it may go on after the window
                if done >= changed:
                    while same < k and limits[same] + shift < done:
                        same += 1
                    if same < k and limits[same] + shift == done:  # from here on the pre-tokens are the old ones
                        found = n, same + 1
                        break
            if found or whole:
                break
            more *= 4
        n, k = found or (len(pieces), len(old))
        self.encoded += n
        fresh, gone = pieces[:n], old[:k]
        if k <= len(block) - i:
            block[i : i + k] = fresh
            self._add(leaf, self.counter.tokens(fresh) - self.counter.tokens(gone), shift)
            return
        own = block[i:]
        block[i:] = fresh
        self._add(leaf, self.counter.tokens(fresh) - self.counter.tokens(own), sum(map(len, fresh)) - sum(map(len, own)))
        k, leaf = k - len(own), leaf + 1
        while k > 0:
            own = self.blocks[leaf][:k]
            del self.blocks[leaf][:k]
            self._add(leaf, -self.counter.tokens(own), -sum(map(len, own)))
            k, leaf = k - len(own), leaf + 1


#: The edits of the production query, what a cleaning step would mask or shorten: addresses, hexadecimal secrets,
#: long numbers, repeated marks.
EDIT_PATTERN = r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)|(?P<secret>\b[0-9a-f]{32,}\b)|(?P<number>\d{4,})|(?P<marks>(?P<mark>[!?.$%&*#|])(?P=mark)+)"
SECRET, NUMBER, MARKS = re.compile(r"[0-9a-f]{32}"), re.compile(r"\d{4,}"), re.compile(r"([!?.$%&*#|])\1+")
EDIT_TEXTS = {"email": "<email>", "secret": "<secret>", "number": "#", "marks": "."}


def edits_of(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """Ranges that don't overlap, in order, with what takes their place."""
    if "@" not in text and not SECRET.search(text):  # then only numbers and marks are left, which never overlap
        found = [(*m.span(), "#") for m in NUMBER.finditer(text)]
        marks = [(*m.span(), ".") for m in MARKS.finditer(text)]
        return sorted(found + marks) if found and marks else found or marks
    return [(m.start(), m.end(), EDIT_TEXTS[m.lastgroup]) for m in pattern.finditer(text)]


def regions(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits (in order, not overlapping), those at most NEAR characters apart as one: their contexts meet."""
    out: list[tuple[int, int, list[str]]] = []
    for start, end, new in edits:
        if out and start - out[-1][1] <= NEAR:
            a, b, parts = out[-1]
            parts += text[b:start], new
            out[-1] = a, end, parts
        else:
            out.append((start, end, [new]))
    return [(a, b, "".join(parts)) for a, b, parts in out]


COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after")])


def count_edited(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens encoded again), n_chars_after, n_tokens_after.

    The edits are those of EDIT_PATTERN, found in the text; if a column `edits` (an array of start, end, text) is there, those are
    applied instead: they must not overlap, and null is none. A null text is empty: all counts 0 unless edits add to it.
    Equal rows get equal results. The vocabulary is a file that every executor can read.
    """
    own = "edits" in docs.columns
    made = [f.name for f in COUNTED]

    def count(texts: pa.Array, given: pa.Array) -> pa.Array:
        counter, pattern, out = Counter.held(vocabulary), re.compile(EDIT_PATTERN), []
        for text, edits in zip(texts.to_pylist(), given.to_pylist(), strict=True):
            text = text or ""
            tree = PretokenTree(text, counter)
            todo = sorted((e["start"], e["end"], e["text"]) for e in edits or []) if own else edits_of(text, pattern)
            row = {"n_pretokens": tree.n, "n_tokens": tree.total, "n_edits": len(todo)}
            for e in reversed(regions(text, todo)):
                tree.edit(*e)
            out.append(row | {"n_reencoded": tree.encoded, "n_chars_after": tree.length, "n_tokens_after": tree.total})
        return pa.array(out, pa.struct([(c, pa.int64()) for c in made]))

    names = [c for c in docs.columns if c not in made]
    counted = F.arrow_udf(count, COUNTED)(F.col("text"), F.col("edits") if own else F.lit(None).cast("int"))
    return docs.select(packed(names), counted.alias("counted")).select(*unpacked(names), "counted.*")


_HELD: dict[str, Counter] = {}


def _held(vocabulary: str) -> Counter:
    """One counter for each worker process."""
    if vocabulary not in _HELD:
        _HELD[vocabulary] = Counter(vocabulary)
    return _HELD[vocabulary]


Counter.held = staticmethod(_held)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edited(docs).drop("text")
