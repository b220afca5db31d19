"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder reads a text from left to right. An Aho-Corasick automaton over the
vocabulary gives the longest token at each place. A token may follow another
only if the two are compatible: merging their joined characters anew, best
score first, ends with just these two. Where no token fits, the place is marked
as failed in a bitfield, the last token is taken back and the next shorter one
tried. The result is the merge result itself, in time linear in the text.

No piece has a space mark after another character, or any character outside
the model's alphabet, so texts are encoded by parts that end there, and parts
that a Python worker has met are looked up. Runs of space marks have equal
scores, which backtracking cannot order: they are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import BoundedCache, map_slices

SPACE = "▁"
#: Parts whose ids a Python worker keeps; they cost far more to encode than to look up.
CACHED_PARTS = 700_000
_NONE = float("-inf")


class _Pairs(dict):
    """Whether a token may follow another, by the two ids; merged anew when first asked, up to a bound kept."""

    def __init__(self, model: BpePieces, entries: int = 400_000):
        super().__init__()
        self.model, self.entries = model, entries

    def __missing__(self, pair: int) -> bool:
        a, b = self.model.text[pair >> 20], self.model.text[pair & 0xFFFFF]
        found = self.model.merged(a + b) == [a, b]
        if len(self) < self.entries:
            self[pair] = found
        return found


class BpePieces:
    """Vocabulary of a BPE model file with byte fallback, its encoder and its decoder."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        plain = [i for i in range(n) if not model.is_byte(i) and i not in self.special and not model.is_unused(i)]
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        if len(self.bytes) != 256 or any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.id):
            raise ValueError("the model needs byte fallback and space marks at the start of pieces only")
        # characters that only longer pieces have take part in merges under ids behind the model's own
        alphabet = sorted({c for p in self.id for c in p})
        self.lone = {c: n + i for i, c in enumerate(c for c in alphabet if c not in self.id)}
        self.n = n
        self.text = {i: p for p, i in self.id.items()} | {i: c for c, i in self.lone.items()}
        ids = self.id | self.lone
        # a piece that its own characters do not merge to is no token of any text
        tokens = {p: i for p, i in ids.items() if len(p) == 1 or (p.strip(SPACE) and self.merged(p) == [p])}
        self.longest = ahocorasick.Automaton()
        for p, i in tokens.items():
            self.longest.add_word(p, (len(p) - 1, i))
        self.longest.make_automaton()
        self.size = {i: len(p) for p, i in tokens.items()}
        self.shorter = {i: next((tokens[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in tokens), None) for p, i in tokens.items()}
        self.compatible = _Pairs(self)
        self.split = re.compile("([^" + re.escape("".join(alphabet)) + "]+)")
        self.foreign = self.split.search
        byte_of = {i: b for b, i in self.bytes.items()}
        #: What an id stands for: a string, or the number of a byte.
        self.stands_for = [byte_of[i] if i in byte_of else "" if i in self.special else self.piece[i] for i in range(n)]
        self.last_odd = max([*byte_of, *self.special])
        self.packed = [struct.pack("<I", i) for i in range(n)]
        self.after_space = BoundedCache(lambda w: self._part(SPACE + w), "pieces", entries=CACHED_PARTS)
        self.at_start = BoundedCache(self._part, "pieces")

    def merged(self, text: str) -> list[str]:
        """Plain merging: the neighbours whose join has the best score first, the left one of ties."""
        if len(text) > 40:
            return self._merged_long(text)
        parts, score = list(text), self.score.get
        scores = [score(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > _NONE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], _NONE)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], _NONE)
        return parts

    def _merged_long(self, text: str) -> list[str]:
        """The same by a heap, for long runs."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p is not None]

    def backtrack(self, text: str) -> list[int]:
        """Tokens of a text of the model's alphabet with at most one space mark, at its start."""
        best: list[int] = [0] * len(text)
        for end, (back, token) in self.longest.iter(text):
            best[end - back] = token  # of one place, longer matches come later
        possible = bytearray(b"\xff") * (len(text) // 8 + 1)
        tokens: list[int] = []
        at, token, total = 0, best[0], len(text)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        while True:
            end = at + size[token]
            if possible[end >> 3] >> (end & 7) & 1 and (not tokens or compatible[tokens[-1] << 20 | token]):
                tokens.append(token)
                at = end
                if at == total:
                    return tokens
                token = best[at]
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                possible[at >> 3] &= ~(1 << (at & 7))
                token = tokens.pop()
                at -= size[token]

    def _bytes(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()]

    def _part(self, text: str) -> tuple[bytes, str, int]:
        """(ids as little-endian unsigned 32-bit integers, their text with space marks, how many) of a part."""
        if not text:
            return b"", "", 0
        if self.foreign(text) is None:
            ids = self.backtrack(text)
        else:
            ids = []
            for piece in filter(None, self.split.split(text)):
                ids.extend(self._bytes(piece) if self.foreign(piece) else self.backtrack(piece))
        if self.lone:
            ids = [i for t in ids for i in ((t,) if t < self.n else self._bytes(self.text[t]))]
        return self._packed(ids)

    def _packed(self, ids: list[int]) -> tuple[bytes, str, int]:
        return b"".join([self.packed[i] for i in ids]), self.joined(ids), len(ids)

    def joined(self, ids: list[int]) -> str:
        """The characters that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        stands_for = self.stands_for
        if not ids or min(ids) > self.last_odd:
            return "".join([stands_for[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            x = stands_for[i]
            if isinstance(x, int):
                raw.append(x)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(x)
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; the mark that encoding puts in front is taken off."""
        text = self.joined(ids)
        return (text[1:] if text[:1] == SPACE else text).replace(SPACE, " ")

    def _run(self, marks: int, word: str) -> list[tuple[bytes, str, int]]:
        """Parts of a word behind ``marks`` space marks: the last one joins the word if it can."""
        first, text, n = self.after_space[word]
        if not word:
            return [self._packed([self.id[p] for p in self.merged(SPACE * marks)])]
        alone = self.id[SPACE]
        if struct.unpack_from("<I", first)[0] != alone:
            return [self._packed([self.id[p] for p in self.merged(SPACE * (marks - 1))]), (first, text, n)]
        return [self._packed([self.id[p] for p in self.merged(SPACE * marks)]), (first[4:], text[1:], n - 1)]

    def parts(self, text: str) -> list[tuple[bytes, str, int]]:
        """A text's parts in order, each with its ids, without begin and end ids."""
        if not text:
            return []
        BoundedCache.claim("pieces")
        out: list[tuple[bytes, str, int]] = []
        text = text.replace(SPACE, " ")
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                out.append(self.at_start["\n"])
            head, *words = line.split(" ")
            if head:
                out.append(self.at_start[head])
            if "  " not in line and line[-1:] != " ":
                out.extend(map(self.after_space.__getitem__, words))
                continue
            marks = 0
            for word in words:
                marks += 1
                if word:
                    out.extend((self.after_space[word],) if marks == 1 else self._run(marks, word))
                    marks = 0
            if marks:
                out.extend(self._run(marks, ""))
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin and end ids."""
        raw = b"".join(p[0] for p in self.parts(text))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))


_LOADED: dict[str, BpePieces] = {}


def loaded(model_file: str) -> BpePieces:
    """The model of a file, read once by each Python worker."""
    if model_file not in _LOADED:
        _LOADED[model_file] = BpePieces(model_file)
    return _LOADED[model_file]


def encoded(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text encoded with begin and end ids, and decoded again.

    Returns doc_id, n_tokens, ids (array of int) and decoded; a null text is
    encoded as an empty one, and repeated rows are encoded alike. One pass, no
    shuffle; the model file is read by every worker at the path given.
    """
    return _each(docs, model_file, doc_id, text, digests=False)


def encoded_digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encoded``, with SHA-256 digests in place of the ids and the text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _each(docs, model_file, doc_id, text, digests=True)


def _each(docs: DataFrame, model_file: str, doc_id: str, text: str, digests: bool) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    results = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        begin, end = struct.pack("<I", model.bos), struct.pack("<I", model.eos)
        for batch in batches:
            sizes, left, right = [], [], []
            for t in batch.column(1).to_pylist():
                parts = model.parts(t or "")
                raw = b"".join([begin, *[p[0] for p in parts], end])
                decoded = "".join([p[1] for p in parts])
                decoded = (decoded[1:] if decoded[:1] == SPACE else decoded).replace(SPACE, " ")
                sizes.append(len(raw) // 4)
                if digests:
                    left.append(hashlib.sha256(raw).hexdigest())
                    right.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    left.append(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
                    right.append(decoded)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
            ids = pa.array(left, pa.string() if digests else pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), ids, pa.array(right, pa.string())], names=[doc_id, *names])

    slim = docs.select(F.col(doc_id), F.col(text))
    return map_slices(slim, encode, f"`{doc_id}` {kind}, n_tokens bigint, {results}")
