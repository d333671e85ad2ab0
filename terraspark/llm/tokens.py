"""Token counts per document, without ever holding a document's token ids.

A BPE model none of whose pieces has the space mark after another character
never merges across "character, space mark", nor across a newline when no piece
holds one. So a text falls into pre-tokens that are encoded alone:

1. Every distinct pre-token of the corpus is encoded once, and its number of pieces
   stored with it as a table.
2. Each document becomes the frequencies of its pre-tokens. They are joined to the
   table and summed, frequency times pieces. The most frequent pre-tokens, at most
   ``HEAD``, go to every executor and are joined where the documents are; what is
   rarer travels and is joined by shuffle. So no hot pre-token is shuffled.

Null and empty texts have 0 tokens. Every row gives one row; repeated rows give
repeated rows; columns beside the id and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspark.llm.common import written

#: Pre-tokens that are sent to every executor.
HEAD = 200_000
#: Distinct pre-tokens, and code points of texts, that a task holds before it hands its counts on.
HELD, HELD_CHARS = 400_000, 1 << 26
#: Longer pre-tokens are never sent to all executors, and are joined by a hash of 128 bits.
LONG = 48
#: Begins the key of spaces that no word follows; no other key has a space after a newline.
TRAILING = "\n "


class PieceCounts(dict):
    """Pre-token -> pieces, made when first asked for. Keys are as ``pre_tokens`` makes them."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_file).encode
        self.blank = len(self.encode("x"))

    def __missing__(self, key: str) -> int:
        n = self[key] = self.count(key)
        return n

    def count(self, key: str) -> int:
        """Pieces of a pre-token, without remembering it."""
        if key[:2] == TRAILING:  # spaces with nothing after them
            return len(self.encode("x" + key[1:])) - self.blank
        if key[:1] == "\n":  # stands after a newline: without the space mark that encode() puts first
            return len(self.encode(key)) - 1
        return len(self.encode(key))


def check_model(model_file: str) -> None:
    """Raise if the model's pieces don't allow the split into pre-tokens."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")


def _runs(parts: list[str], lead: str) -> list[str]:
    """Pre-tokens of a line that holds runs of spaces. lead: what the first one begins with."""
    out, blanks = [], ""
    first, last = True, len(parts) - 1
    for i, part in enumerate(parts):
        if part or (first and lead):
            out.append(lead + part if first and lead else blanks + part)
            first, blanks = False, ""
        elif i < last:
            blanks += " "
            continue
        else:
            out.append(TRAILING + blanks)
        first = False
    return out


def pre_tokens(text: str) -> list[str]:
    """Keys for ``PieceCounts``; counts of the keys add up to the count of the text.

    A plain key is a word with all but one of the spaces before it, since encode()
    itself puts one first.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        lead = "\n" if i else ""
        parts = line.split(" ")
        if i == 0 and not line:
            # nothing before the first newline but encode()'s own space mark
            out.append(TRAILING)
        elif "" not in parts[1:] and (parts[0] or lead):
            parts[0] = lead + parts[0]
            out += parts
        elif i == 0:
            out += _first_line(parts)
        else:
            out += _runs(parts, lead)
    return out


def _first_line(parts: list[str]) -> list[str]:
    """As _runs, for the text's first line: the mark that encode() puts first joins the leading spaces."""
    lead = 0
    while lead < len(parts) and not parts[lead]:
        lead += 1
    if lead == len(parts):  # spaces alone
        return [TRAILING + " " * (len(parts) - 1)]
    return [" " * lead + parts[lead], *_runs(["-", *parts[lead + 1 :]], "")[1:]]


def weigh(frequency: Counter, counts: PieceCounts) -> int:
    return sum(map(mul, frequency.values(), map(counts.__getitem__, frequency)))


def _file(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def join_key(t: str) -> str:
    """The pre-token, or for a long one its hash. No pre-token begins with two newlines."""
    import xxhash

    return t if len(t) <= LONG else "\n\n" + xxhash.xxh3_128_hexdigest(t.encode())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (t, n): pre-tokens of a task, each once or, where there are very many, a few times."""
    found: Counter = Counter()
    chars = 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["t", "n"])
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            found.update(pre_tokens(text))
            chars += len(text)
            if len(found) >= HELD or chars >= HELD_CHARS:
                yield give()
                found.clear()
                chars = 0
    if found:
        yield give()


def piece_table(docs: DataFrame, text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(t, n long, pieces int): every distinct pre-token of the corpus (long ones as ``join_key``), how often it stands there, and its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _file(model)
        count = None
        for batch in batches:
            if count is None:
                check_model(file)
                count = PieceCounts(file).count
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(join_key, found)), pa.string()), batch.column(1), pa.array(list(map(count, found)), pa.int32())], names=["t", "n", "pieces"])

    seen = docs.select(F.col(text_col)).mapInArrow(_tally, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return seen.mapInArrow(run, "t string, n long, pieces int")


def frequent(table: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The pieces of the most frequent pre-tokens that are not long, at most ``most`` of them, and how many pre-tokens there are in all.

    So at most ``most`` times ``LONG`` code points come to the driver, whatever the texts hold.
    Frequencies are counted in eighths of a power of two, some hundred numbers at the most, to
    find the least frequency that few enough reach; only what reaches it comes to the driver.
    """
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    short = ~F.col("t").startswith("\n\n")
    counts = sorted(((r["s"], r["c"], r["k"]) for r in table.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c"), F.count_if(short).alias("k")).collect()), reverse=True)
    least, held = None, 0
    for s, _, c in counts:
        if held + c > most:
            break
        least, held = s, held + c
    rows = [] if least is None else table.filter((step >= least) & short).select("t", "pieces").collect()
    return {r["t"]: r["pieces"] for r in rows}, sum(c for _, c, _ in counts)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", head: int | None = None) -> DataFrame:
    """(id, n_bytes long, n_tokens long) for every row. ``model``: name of a public vocabulary, or a path."""
    spark = docs.sparkSession
    head = HEAD if head is None else head
    table = written(spark, piece_table(docs, text_col, model), "pre_tokens")
    often, every = frequent(table, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_bytes, n_tokens, at, rest = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                frequency = Counter(pre_tokens(text))
                if max(map(len, frequency), default=0) > LONG:
                    frequency = {join_key(t): f for t, f in frequency.items()}
                n_bytes.append(len(text.encode()))
                pieces = list(map(often.get, frequency))
                if None in pieces:
                    rest.append([{"t": t, "f": f} for (t, f), p in zip(frequency.items(), pieces, strict=True) if p is None])
                    n_tokens.append(sum(f * p for f, p in zip(frequency.values(), pieces, strict=True) if p is not None))
                else:
                    rest.append(None)
                    n_tokens.append(sum(map(mul, frequency.values(), pieces)))
                at.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(at, pa.int64()), pa.array(rest, pa.list_(pa.struct([("t", pa.string()), ("f", pa.int32())])))], names=[id_col, "n_bytes", "n_tokens", "_row", "_rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, _row long, _rest array<struct<t: string, f: int>>")
    if len(often) == every:  # no pre-token is left for the shuffle
        return joined.select(id_col, "n_bytes", "n_tokens")
    joined = written(spark, joined, "frequencies")
    rare = joined.filter("_rest IS NOT NULL").select(F.col("_row").alias("_r"), F.explode("_rest").alias("_x")).select("_r", "_x.t", "_x.f")
    rare = rare.join(table.select("t", "pieces").hint("merge"), "t").groupBy("_r").agg(F.sum(F.col("f") * F.col("pieces")).alias("_more"))
    out = joined.drop("_rest").join(rare.hint("merge"), F.col("_row") == F.col("_r"), "left")
    return out.select(id_col, "n_bytes", (F.col("n_tokens") + F.coalesce("_more", F.lit(0))).alias("n_tokens"))
