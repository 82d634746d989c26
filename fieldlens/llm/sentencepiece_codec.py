"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of code points, cut into words no piece
can cross. The distinct words are encoded together: symbols of all words lie
end to end, each round finds the best pair of every word by a segmented
minimum over pair ranks, merges its leftmost occurrences at once, and compacts
the array, until no pair remains. Texts are then put together from their words.

Merging all occurrences of a pair in one round equals the library's one by one
order unless a merge makes a still better pair; a word where that would happen
merges only its first occurrence in that round.

Nulls count as empty texts; an empty text has no ids and decodes to "". Very long
texts are read whole, a run of one word at a time; equal words of a batch are
encoded once. Repeated rows and null ids stay, each its own row; an empty table gives
an empty result. Columns other than id and text are not read, so their names
can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk

_MARK = 0x2581
_NONE = np.int64(2**31 - 1)
_loaded: dict[str, "Codec"] = {}


class Codec:
    """Tables of one model file, and both directions."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        if sum(byte) != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.size = n
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.cut_at_mark = not any("▁" in p.lstrip("▁") for p in plain)
        by_score = sorted(plain.values(), key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(by_score)}
        pairs = sorted({(plain[p[:k]] * n + plain[p[k:]], i, rank[i]) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain})
        self.pair_key = np.array([x[0] for x in pairs] or [-1], np.int64)
        self.pair_id = np.array([x[1] for x in pairs] or [-1], np.int64)
        self.pair_rank = np.array([x[2] for x in pairs] or [_NONE], np.int64)
        #: What a piece adds to the decoded text.
        self.surface = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.name = [str(i) for i in range(n)]

    @staticmethod
    def load(path: str) -> "Codec":
        if path not in _loaded:
            _loaded[path] = Codec(path)
        return _loaded[path]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; _NONE where there is no such piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], _NONE), np.where(hit, self.pair_id[at], -1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each word's symbols until no pair remains; words lie end to end. Ids and their number per word."""
        n_words = len(lengths)
        word = np.repeat(np.arange(n_words), lengths)
        done_sym, done_word = [], []
        sym = symbols.astype(np.int64)
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.concatenate((first, [len(sym)])))
            best = np.minimum.reduceat(rank, first)
            if (best == _NONE).any():  # these words are done
                idle = np.repeat(best == _NONE, size)
                done_sym.append(sym[idle])
                done_word.append(word[idle])
                keep = ~idle
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.flatnonzero(rank == np.repeat(best, size))
            if len(at) > 1:  # in a run of overlapping pairs every other one goes
                fresh = np.concatenate(([True], np.diff(at) != 1))
                nth = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[nth % 2 == 0]
            at = self._only_safe(at, sym, word, rank, made)
            new = made[at]
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            stale = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[stale] = _NONE
            inner = stale[stale < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner], made[inner] = self._rank(sym[inner], sym[inner + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words)

    def _only_safe(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of a word whose merges would make a better pair, only the first occurrence."""
        many = np.concatenate((word[at][1:] == word[at][:-1], [False]))
        many[1:] |= many[:-1].copy()
        if not many.any():
            return at
        x = at[many]
        new, was = made[x], rank[x]
        after = np.minimum(x + 2, len(sym) - 1)
        right = np.where((x + 2 < len(sym)) & (word[after] == word[x]), sym[after], -1)
        before = np.maximum(x - 1, 0)
        left = np.where((x > 0) & (word[before] == word[x]), sym[before], -1)
        joined = np.concatenate(([False], (np.diff(x) == 2) & (word[x][1:] == word[x][:-1])))  # the left neighbour is a merged pair too
        left = np.where(joined, new, left)
        bad = (self._rank(left, new)[0] < was) | (self._rank(new, right)[0] < was)
        if not bad.any():
            return at
        first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
        return at[first | ~np.isin(word[at], word[x][bad])]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words, their counts, and the words of each text: word number, text number."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        n = len(points)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        known = self.char_id[points] >= 0
        starts = ~known
        starts[1:] |= ~known[:-1]
        if self.cut_at_mark:
            mark = points == _MARK
            starts[1:] |= mark[1:] & ~mark[:-1]
        starts[offsets[:-1][sizes > 0]] = True
        begin = np.flatnonzero(starts)
        end = np.concatenate((begin[1:], [n]))
        doc = np.searchsorted(offsets, begin, "right") - 1
        powers, inverses = tk._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tk.mix(points.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        _, at, which = np.unique(tk.mix((sums[end] - sums[begin]) * inverses[begin]), return_index=True, return_inverse=True)
        length = (end - begin)[at]
        symbols = self.char_id[points[tk.ragged(begin[at], length)]]
        ids, counts = self.merge(symbols, length)
        odd = np.flatnonzero((length == 1) & ~known[begin[at]])  # characters without a piece: the ids of their bytes
        if len(odd):
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in points[begin[at[odd]]]]
            size = np.ones(len(counts), np.int64)
            size[odd] = [len(c) for c in coded]
            base = np.concatenate(([0], np.cumsum(counts)[:-1]))
            wide = counts.copy()
            wide[odd] = size[odd]
            out = np.empty(int(wide.sum()), np.int64)
            to = np.concatenate(([0], np.cumsum(wide)[:-1]))
            rest = np.ones(len(counts), bool)
            rest[odd] = False
            out[tk.ragged(to[rest], counts[rest])] = ids[tk.ragged(base[rest], counts[rest])]
            out[tk.ragged(to[odd], size[odd])] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
            ids, counts = out, wide
        return ids, counts, which, doc

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts, which, doc = self.encode_flat(texts)
        base = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        flat = ids[tk.ragged(base[which], counts[which])] if len(which) else ids
        total = np.bincount(doc, counts[which], len(texts)).astype(np.int64) if len(which) else np.zeros(len(texts), np.int64)
        return np.split(flat, np.cumsum(total)[:-1]) if texts else []

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids, as the library's decode gives it; broken UTF-8 becomes U+FFFD."""
        return self._text(b"".join([self.surface[i] for i in ids])).decode("utf-8", "replace")

    @staticmethod
    def _text(joined: bytes) -> bytes:
        return joined[1:] if joined[:1] == b" " else joined


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 3 << 20) -> DataFrame:
    """Encodes and decodes every text; one row per document with the number of ids and digests of ids and decoded text.

    Null or empty text: 0 ids, digests of the empty string. Repeated rows and null ids stay as they are.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in batches:
            texts = tk.as_strings(batch.column(1))
            data, offsets = tk.raw(texts)
            for a, b, _, _ in tk.chunks(data, offsets, chunk_bytes):
                part = texts.slice(a, b - a).to_pylist()
                ids, counts, which, doc = codec.encode_flat(part)
                words = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
                lists = [w.tolist() for w in words]
                named = np.array([",".join([codec.name[i] for i in w]) for w in lists] + [""], object)[:-1]
                shown = np.array([b"".join([codec.surface[i] for i in w]) for w in lists] + [b""], object)[:-1]
                total = np.bincount(doc, counts[which], b - a).astype(np.int64) if len(which) else np.zeros(b - a, np.int64)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                rows = [(hashlib.sha256(",".join(named[w].tolist()).encode()).hexdigest(), hashlib.sha256(codec._text(b"".join(shown[w].tolist()))).hexdigest()) for w in (which[at[i] : at[i + 1]] for i in range(b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(total), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tk.tidy(digests), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
