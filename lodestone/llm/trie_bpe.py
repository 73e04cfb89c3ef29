"""BPE encoding by a prefix-sharing trie, and decoding.

A worker gathers the distinct words of a batch; sorted, they are the leaves of
their trie in depth-first order, and the walk keeps at each node of the current
path the state of the prefix that ends there: the last token of the prefix's
encoding. That token is the one suffix token that is compatible with the last
token of the prefix before it; so the encoding of a prefix that many words share
is computed once, and a word's tokens are read back along its path.

Two adjacent tokens are compatible if the merges leave the border between them
alone: no piece on the right edge of the first and on the left edge of the
second merge with each other before either is consumed within its own token.

Texts are cut at ASCII white space before anything else; no normalisation, no
pre-token and no merge of these vocabularies (those whose white space is dropped
and whose words end in a suffix) crosses it.

Defined results: a null or empty text has no tokens and decodes to the empty
text; characters outside the vocabulary without an unknown token are dropped, as
the tokenizers library drops them; texts of any length are encoded whole; of merges of
one rank there is one, so there are no ties; repeated rows are encoded alike; an empty
table gives an empty table; other columns pass through, and a column that has the
result's name gives way to it.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

def _byte_symbols() -> str:
    """The 256 characters that stand for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


BYTE_SYMBOLS = _byte_symbols()

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


class Merges:
    """Which tokens may stand side by side, from the ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = vocab[left], vocab[right]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[left + right], (*pair, rank))
        self.right_edges: dict[int, list[tuple[int, float]]] = {}
        self.left_edges: dict[int, list[tuple[int, float]]] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of a token, each with the rank that consumes it."""
        cache = self.right_edges if side else self.left_edges
        found = cache.get(token)
        if found is None:
            found, piece, until = [], token, float("inf")
            while True:
                found.append((piece, until))
                if piece not in self.parts:
                    break
                until = self.parts[piece][2]
                piece = self.parts[piece][side]
            cache[token] = found
        return found

    def compatible(self, first: int, second: int) -> bool:
        pair = first, second
        found = self.known.get(pair)
        if found is None:
            found, rank = True, self.rank
            for a, a_until in self.edge(first, 1):
                for b, b_until in self.edge(second, 0):
                    m = rank.get((a, b))
                    # at equal ranks the merge further left comes first
                    if m is not None and m < a_until and m <= b_until:
                        found = False
                        break
                if not found:
                    break
            if len(self.known) >= common.TABLE_ENTRIES:
                self.known.clear()
            self.known[pair] = found
        return found


class Suffixes:
    """For the path read so far: all vocabulary tokens that end where it ends, longest first."""

    def __init__(self, tokens: dict[str, int], split):
        self.step: list[dict[str, int]] = [{}]
        own: list[int | None] = [None]
        depths = [0]
        for text, token in tokens.items():
            state = 0
            for symbol in split(text):
                follower = self.step[state].get(symbol)
                if follower is None:
                    follower = len(self.step)
                    self.step[state][symbol] = follower
                    self.step.append({})
                    own.append(None)
                    depths.append(depths[state] + 1)
                state = follower
            own[state] = token
        size = len(self.step)
        self.fall = [0] * size
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * size
        leaf: dict[str, int] = {}  # one empty table for all states without followers
        self.step = [x or leaf for x in self.step]
        order = sorted(((depths[b], a, c, b) for a in range(size) for c, b in self.step[a].items()), key=lambda x: x[0])
        for depth, parent, symbol, state in order:
            self.fall[state] = self.follow(self.fall[parent], symbol, self.step) if parent else 0
            below = self.ends[self.fall[state]]
            self.ends[state] = below if own[state] is None else ((own[state], depth), *below)

    def follow(self, state: int, symbol: str, steps: list[dict[str, int]]) -> int:
        while True:
            follower = steps[state].get(symbol)
            if follower is not None:
                return follower
            if not state:
                return 0
            state = self.fall[state]


class TrieEncoder:
    """Encodes lists of words; a word is a string whose last symbol carries the end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.merges = Merges(vocab, merges)
        self.suffixes = Suffixes(vocab, self.symbols_of_token)
        self.complete = all(c in vocab and c + suffix in vocab for c in BYTE_SYMBOLS)

    def symbols_of_token(self, token: str) -> list[str]:
        if self.suffix and len(token) > len(self.suffix) and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """word -> ids. Symbols outside the vocabulary are dropped.

        The sorted words are the leaves of their trie in depth-first order: what a
        word shares with the one before it is the path that stays, and only the
        nodes below are entered. The last symbol carries the end suffix, so it is a
        leaf of its own.
        """
        suffix, ends, steps, follow = self.suffix, self.suffixes.ends, self.suffixes.step, self.suffixes.follow
        known, compatible = self.merges.known, self.merges.compatible
        found: dict[str, list[int]] = {}
        last, width, states = [-1], [0], [0]  # along the path: last token, its symbols, suffix state
        before = ""
        for word in sorted(set(words)):
            clean = word if self.complete else self.only_known(word)
            if not clean:
                found[word] = []
                continue
            body = clean[:-1]
            size = len(body)
            keep, most = 0, min(size, len(before))
            while keep < most and body[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], width[keep + 1 :], states[keep + 1 :]
            state = states[-1]
            for depth, symbol in enumerate((*body[keep:], clean[-1] + suffix), keep + 1):
                now = steps[state].get(symbol)
                if now is None:
                    now = follow(state, symbol, steps)
                for token, n in ends[now]:
                    if n == depth:
                        break
                    left = last[depth - n]
                    fits = known.get((left, token))
                    if fits or fits is None and compatible(left, token):
                        break
                else:
                    raise AssertionError("no token ends this prefix")
                if depth > size:
                    break
                last.append(token)
                width.append(n)
                states.append(now)
                state = now
            ids, at = [token], size + 1 - n
            while at:
                ids.append(last[at])
                at -= width[at]
            ids.reverse()
            found[word] = ids
            before = body
        return found

    def only_known(self, word: str) -> str:
        """The word without symbols that the vocabulary lacks; its last symbol counts with the suffix."""
        end = word[-1] if word[-1] + self.suffix in self.vocab else ""
        return "".join([c for c in word[:-1] if c in self.vocab]) + end


class Tokenizer:
    """A vocabulary file of the tokenizers library whose white space is dropped and
    whose words end in a suffix; its own normaliser and pre-tokeniser cut the words."""

    # Chunks of these characters are their own normal form but for case, and fall into
    # letters, digits and signs as below; all others go through the library's parts.
    _LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
    _PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[!-/:-`{-~]+")
    _TO_SYMBOLS = dict(enumerate(BYTE_SYMBOLS))

    def __init__(self, spec: str):
        import tokenizers

        parts = json.loads(spec)
        model = parts["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or model["byte_fallback"] or parts["decoder"] or model["ignore_merges"]:
            raise ValueError("not a BPE vocabulary of this kind")
        library = tokenizers.Tokenizer.from_str(spec)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.added = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.vocab = model["vocab"] | self.added
        self.token_of = {i: t for t, i in self.vocab.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.trie = TrieEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.table = common.WordTable(self.encode_chunks, 300_000)

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a text without white space, as byte-level strings."""
        if self._LATIN.fullmatch(chunk):
            parts = self._PARTS.findall(chunk.lower())
            return parts if chunk.isascii() else [p.encode().decode("latin-1").translate(self._TO_SYMBOLS) for p in parts]
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def pieces(self, chunk: str) -> list[tuple[bool, str]]:
        """(is an added token, string) of a chunk."""
        if self.cut is None or "<|" not in chunk:
            return [(False, w) for w in self.words(chunk)]
        found = []
        for i, part in enumerate(self.cut.split(chunk)):
            found += [(True, part)] if i % 2 else [(False, w) for w in self.words(part)] if part else []
        return found

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk as packed 32-bit integers."""
        cut = [self.pieces(c.decode("utf-8", "replace")) for c in chunks]
        ids_of = self.trie.encode([w for ws in cut for special, w in ws if not special])
        found = []
        for ws in cut:
            ids = [i for special, w in ws for i in ((self.added[w],) if special else ids_of[w])]
            found.append(struct.pack(f"<{len(ids)}i", *ids))
        return found

    def decode(self, packed: bytes) -> bytes:
        """The tokens joined by a space, as the library decodes without a decoder."""
        return " ".join(map(self.token_of.__getitem__, np.frombuffer(packed, "<i4").tolist())).encode()


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """docs with one struct column more, named out: ``ids`` and the ``decoded`` text.

    No shuffle: each worker keeps a bounded table of the words that it met. The
    vocabulary file is read on the driver and broadcast (it has a fixed size).
    """
    common.small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.struct([("ids", pa.list_(pa.field("element", pa.int32(), False))), ("decoded", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.lean_worker()
        tokenizer = Tokenizer(spec.value)
        table = tokenizer.table
        gc.freeze()  # the automaton has many small parts; do not walk them again and again
        for texts in batches:
            packed, decoded = [], []
            for portion in common.portions(common.binaries(texts)):
                words = [x.split() for x in portion]
                table.admit(words)
                for ws in words:
                    packed.append(b"".join(map(table.__getitem__, ws)))
                    decoded.append(tokenizer.decode(packed[-1]))
            offsets = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), type=kind.field("ids").type)
            yield pa.StructArray.from_arrays([ids, common.utf8(decoded)], fields=list(kind))

    return docs.withColumn(out, F.arrow_udf(run, ENCODED)(common.as_bytes(text)))
