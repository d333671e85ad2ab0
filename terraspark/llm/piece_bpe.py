"""SentencePiece (BPE with byte fallback) encoding and decoding in merge rounds over flat arrays.

A text is taken in stretches of ``STRETCH`` code points, cut between two code points
that stand side by side in no piece of the vocabulary: no merge crosses such a place,
so the words between them are encoded alone and the result is that of the whole text.
Each word a task has not met is encoded once, all new words of a stretch together:

* the symbols of all words lie in one flat array, with the rank of each pair of
  neighbours beside it (a rank is the place of the score of the piece they give);
* a round takes the least rank of each word by a segmented minimum and merges its
  pairs from the left, pairs that overlap one another apart;
* where a merge makes a pair of the same or a lower rank, which the library would take
  next, the word goes through the round from left to right, symbol by symbol;
* what was merged is closed up, and words without a pair left go to the results.

Texts then are gathered from the ids of their words, their decimal ids and decoded
bytes from tables of pieces. A decoded text is what the library's decode(ids) gives.

Null and empty texts have no ids. Every row gives one row; columns beside the id and
the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspark.llm.common import portions

#: Code points that are encoded at a time.
STRETCH = 1 << 20
#: Code points of words that a task remembers with their ids.
REMEMBERED = 1 << 23
#: The rank of a pair that gives no piece.
NEVER = np.iinfo(np.int32).max
SPACE = "▁"


def _mix(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the pieces [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Tables of a SentencePiece BPE model: symbols, pairs, the bytes and the decimal id of each piece."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = proto.ModelProto.FromString(model.serialized_model_proto())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = proto.ModelProto.SentencePiece
        if train.model_type != proto.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that keep texts as they are, with a space mark first, are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user defined or unused pieces are not supported")
        names = [p.piece for p in spec.pieces]
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        byte_ids = [i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE]
        self.size = len(names)
        self.first_byte = byte_ids[0]
        if byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
            raise ValueError("byte pieces are not in one run")

        # symbols: ids of pieces, then code points that pieces hold but that are none themselves, then one for all others
        inner = sorted({c for p in normal for c in p} - set(normal))
        symbols = normal | {c: self.size + i for i, c in enumerate(inner)}
        self.other = self.size + len(inner)
        self.of_code = np.full(0x110000, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i

        # pairs that give a piece, in a table with open places
        scores = sorted({spec.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {(symbols[p[:k]], symbols[p[k:]]): i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        gives = np.array(list(pairs.values()), np.int32)
        ranks = np.array([rank[spec.pieces[i].score] for i in pairs.values()], np.int32)
        self.merge = dict(zip(keys.tolist(), zip(ranks.tolist(), gives.tolist())))
        self.bits = max(len(keys) * 8, 16).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.gives, self.ranks = np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, NEVER, np.int32)
        self.steps, at, left = 0, self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            taken, one = np.unique(at[free], return_index=True)
            row = left[free][one]
            self.keys[taken], self.gives[taken], self.ranks[taken] = keys[row], gives[row], ranks[row]
            more = self.keys[at] != keys[left]
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

        # code points that stand side by side in a piece
        within = sorted({c for p in normal if len(p) > 1 for c in p})
        group = {c: i + 1 for i, c in enumerate(within)}
        self.group = np.zeros(0x110000, np.int32)
        self.group[[ord(c) for c in within]] = np.arange(1, len(within) + 1)
        self.joins = np.zeros((len(within) + 1, len(within) + 1), bool)
        for p in normal:
            for a, b in zip(p, p[1:]):
                self.joins[group[a], group[b]] = True

        # what ids stand for
        texts = [bytes([i - byte_ids[0]]) if byte_ids[0] <= i <= byte_ids[-1] else names[i].replace(SPACE, " ").encode() if names[i] in normal else b"" for i in range(self.size)]
        self.text, self.text_at, self.text_n = self._table(texts)
        self.decimal, self.decimal_at, self.decimal_n = self._table([b"%d," % i for i in range(self.size)])
        self.controls = [p.type in (kinds.CONTROL, kinds.UNKNOWN) for p in spec.pieces]

    @staticmethod
    def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in items], np.int64)
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting piece of each pair of symbols; the rank is NEVER where they give none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._place(keys)
        found = self.keys[at]
        ranks, gives = self.ranks[at], self.gives[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        ranks[found != keys] = NEVER
        for _ in range(self.steps):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = at[open_]
            hit = self.keys[there] == keys[open_]
            ranks[open_[hit]], gives[open_[hit]] = self.ranks[there[hit]], self.gives[there[hit]]
            open_ = open_[~hit & (self.keys[there] != -1)]
        return ranks, gives

    # -- encoding

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each code point but the first: whether it begins a word."""
        g = self.group[codes]
        return ~self.joins[g[:-1], g[1:]]

    def _rounds(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges words laid end to end. Returns (word, place of its first code point, symbol) of all symbols left, by word and place."""
        n = len(codes)
        symbol, place = self.of_code[codes], np.arange(n)
        lengths = np.diff(np.append(starts, n))
        word = np.repeat(np.arange(len(starts)), lengths)
        rank, gives = np.full(n, NEVER, np.int32), np.zeros(n, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], gives[inside] = self.pair(symbol[inside], symbol[inside + 1])
        done = []
        while n:
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, n))
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, lengths)
                done.append((word[gone], place[gone], symbol[gone]))
                stay = ~gone
                word, place, symbol, rank, gives = word[stay], place[stay], symbol[stay], rank[stay], gives[stay]
                lengths, least, n = lengths[~over], least[~over], len(word)
                if not n:
                    break
            # every other one of neighbouring pairs of the least rank, from the left
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            first = np.flatnonzero(run)
            take = hit[((np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) & 1) == 0]
            keep = np.ones(n, bool)
            changed = []
            apart = self._lowering(take, word, symbol, rank, gives, n)
            if len(apart):
                take = take[~np.isin(word[take], apart)]
                for w in apart:
                    a, b = np.searchsorted(word, [w, w + 1])
                    at, symbols = self._scan(symbol[a:b].tolist(), int(rank[a:b].min()))
                    keep[a:b] = False
                    keep[a + at], symbol[a + at] = True, symbols
                    changed.append(a + at)
            symbol[take] = gives[take]
            keep[take + 1] = False
            new = (np.cumsum(keep) - 1)[np.concatenate([take, *changed])]
            word, place, symbol, rank, gives = word[keep], place[keep], symbol[keep], rank[keep], gives[keep]
            n = len(word)
            # the pairs that the new symbols stand in
            near = np.zeros(n + 1, bool)
            near[new] = near[new - 1] = True
            touched = np.flatnonzero(near[:n])
            rank[touched] = NEVER
            touched = touched[touched < n - 1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], gives[touched] = self.pair(symbol[touched], symbol[touched + 1])
        word, place, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(place, kind="stable")
        return word[order], place[order], symbol[order]

    def _lowering(self, take: np.ndarray, word: np.ndarray, symbol: np.ndarray, rank: np.ndarray, gives: np.ndarray, n: int) -> np.ndarray:
        """The words where one of the merges makes a pair of the rank at hand or a lower one."""
        lower = np.zeros(len(take), bool)
        right = take + 2 < n
        right[right] = word[take[right] + 2] == word[take[right]]
        r = np.flatnonzero(right)
        lower[r] = self.pair(gives[take[r]], symbol[take[r] + 2])[0] <= rank[take[r]]
        left = take > 0
        left[left] = word[take[left] - 1] == word[take[left]]
        before = symbol[take - 1]
        chained = np.append(False, take[1:] == take[:-1] + 2) & left
        before[chained] = gives[take[np.flatnonzero(chained) - 1]]
        at = np.flatnonzero(left)
        lower[at] |= self.pair(before[at], gives[take[at]])[0] <= rank[take[at]]
        return np.unique(word[take[lower]])

    def _scan(self, symbols: list[int], most: int) -> tuple[np.ndarray, list[int]]:
        """Merges of rank ``most`` and lower in one word from left to right: places and symbols that are left.

        Left of the place at hand no pair has so low a rank, and right of it none has a
        lower one: so a pair that a merge makes is the next of all if its rank is low enough.
        """
        merge, none = self.merge.get, (NEVER, 0)
        at, out, i, n = [0], [symbols[0]], 1, len(symbols)
        while True:
            right = merge(out[-1] << 32 | symbols[i], none) if i < n else none
            left = merge(out[-2] << 32 | out[-1], none) if len(out) > 1 else none
            if left[0] <= most and left[0] <= right[0]:
                at.pop()
                out.pop()
                out[-1] = left[1]
            elif right[0] <= most:
                out[-1] = right[1]
                i += 1
            elif i < n:
                at.append(i)
                out.append(symbols[i])
                i += 1
            else:
                return np.array(at), out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. Words are not empty and hold no plain space."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word, place, symbol = self._rounds(codes, np.cumsum(lengths) - lengths)
        # code points that are no piece: their bytes
        raw = np.flatnonzero(symbol >= self.size)
        n = np.ones(len(symbol), np.int64)
        c = codes[place[raw]]
        n[raw] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(symbol, n)
        at = np.cumsum(n) - n
        for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            which = n[raw] == size
            code, start = c[which], at[raw[which]]
            for k in range(size):
                part = code >> 6 * (size - 1 - k)
                ids[start + k] = self.first_byte + (part | lead if k == 0 else part & 0x3F | 0x80)
        return ids, np.bincount(word, weights=n, minlength=len(words)).astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.text[_ragged(self.text_at[ids], self.text_n[ids])]

    def decode(self, ids) -> str:
        """As the library: bytes put together, one space mark at the very beginning left out."""
        return self._whole(self.decode_bytes(np.asarray(ids, np.int64)).tobytes(), ids)

    def _whole(self, text: bytes, ids) -> str:
        shown = next((i for i in ids if not self.controls[i]), None)
        if shown is not None and text[:1] == b" " and not self.first_byte <= shown < self.first_byte + 256:
            text = text[1:]
        return text.decode("utf-8", "replace")


class Encoder:
    """Encodes texts with a vocabulary and remembers words, at most ``REMEMBERED`` code points of them."""

    def __init__(self, vocabulary: Vocabulary, stretch: int = STRETCH, remembered: int = REMEMBERED):
        self.v, self.stretch, self.most = vocabulary, stretch, remembered
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.held = 0
        self.ids, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _words(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Rows of the words of a text that begin at ``starts``."""
        bounds = starts.tolist()
        bounds.append(len(text))
        words = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        found = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(found < 0)
        if not len(unmet):
            return found
        size = sum(map(len, new := dict.fromkeys(map(words.__getitem__, unmet.tolist()))))
        if self.held and self.held + size > self.most:
            self._forget()
            return self._words(text, starts)
        new = list(new)
        ids, n = self.v.encode_words(new)
        self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
        self.n = np.append(self.n, n)
        self.ids = np.append(self.ids, ids.astype(np.int32))
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.held += size
        found[unmet] = [self.rows[words[i]] for i in unmet.tolist()]
        return found

    def stretches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, ids) of parts of the texts, in order; the ids of a stretch of several texts come text by text."""
        batch: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            text = SPACE + text.replace(" ", SPACE)
            if len(text) >= self.stretch:
                yield from self._together(batch)
                batch, size = [], 0
                for part in self._parts(text):
                    yield from self._together([(i, part)])
                continue
            batch.append((i, text))
            size += len(text)
            if size >= self.stretch:
                yield from self._together(batch)
                batch, size = [], 0
        yield from self._together(batch)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut between words into parts of about a stretch."""
        begin, end = 0, self.stretch
        while end < len(text):
            codes = np.frombuffer(text[begin:end].encode("utf-32-le", "surrogatepass"), np.uint32)
            cut = np.flatnonzero(self.v.cuts(codes))
            if len(cut):
                yield text[begin : begin + cut[-1] + 1]
                begin += int(cut[-1]) + 1
                end = begin + self.stretch
            else:  # no word ends here: look twice as far
                end = begin + 2 * (end - begin)
        yield text[begin:]

    def _together(self, batch: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not batch:
            return
        text = "".join(t for _, t in batch)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.append(True, self.v.cuts(codes))
        lengths = np.array([len(t) for _, t in batch])
        begins[np.cumsum(lengths)[:-1]] = True
        starts = np.flatnonzero(begins)
        rows = self._words(text, starts)
        n = self.n[rows]
        ids = self.ids[_ragged(self.at[rows], n)]
        per_word = np.searchsorted(np.cumsum(lengths), starts, "right")
        per_text = np.bincount(per_word, weights=n, minlength=len(batch)).astype(np.int64)
        ends = np.cumsum(per_text)
        for (i, _), a, b in zip(batch, (ends - per_text).tolist(), ends.tolist()):
            yield i, ids[a:b]

    def encode(self, text: str) -> np.ndarray:
        found = [ids for _, ids in self.stretches([text])]
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, digest of the decimal ids and digest of the decoded text, for each text."""
        count = [0] * len(texts)
        of_ids, of_text = [None] * len(texts), [None] * len(texts)
        v, empty = self.v, hashlib.sha256().hexdigest()
        for i, ids in self.stretches(texts):
            decimal = v.decimal[_ragged(v.decimal_at[ids], v.decimal_n[ids])].tobytes()
            decoded = v.decode_bytes(ids).tobytes()
            if of_ids[i] is None:  # the comma after the last id of a part waits for the next part
                of_ids[i], of_text[i] = hashlib.sha256(decimal[:-1]), hashlib.sha256(decoded[1:])
            else:
                of_ids[i].update(b"," + decimal[:-1])
                of_text[i].update(decoded)
            count[i] += len(ids)
        return count, [h.hexdigest() if h else empty for h in of_ids], [h.hexdigest() if h else empty for h in of_text]


def _file(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def _map(docs: DataFrame, id_col: str, text_col: str, model: str, fields: str, work: Callable[[Encoder, pa.Array], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(_file(model)))
            for part in portions(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *work(encoder, part.column(1))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", *(f.split()[0] for f in fields.split(", "))]
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {fields}")
    return found.withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids array<int>) for every row. ``model``: name of a public vocabulary, or a path."""

    def work(encoder: Encoder, texts: pa.Array) -> list:
        values = [t or "" for t in texts.to_pylist()]
        parts, n = [], np.zeros(len(values) + 1, np.int64)
        for i, ids in encoder.stretches(values):
            parts.append(ids)
            n[i + 1] += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(flat, pa.int32()))]

    return _map(docs, id_col, text_col, model, "ids array<int>", work)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, text) for every row of ids. Null gives the empty text; an id outside the vocabulary raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for batch in batches:
            v = v or Vocabulary(_file(model))
            lists = batch.column(1)
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    found = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(run, f"_id {kind}, text string")
    return found.withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) for every row: encodes, then decodes the ids."""

    def work(encoder: Encoder, texts: pa.Array) -> list:
        n, ids, decoded = encoder.digests([t or "" for t in texts.to_pylist()])
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _map(docs, id_col, text_col, model, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
