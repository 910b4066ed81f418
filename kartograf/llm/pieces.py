"""SentencePiece encoding and decoding; giant documents are cut into chunks by a max-plus scan.

The best segmentation maximises the sum of piece scores.  A chunk maps the score of every place where
the last piece before it may end (its entries) to the score of every place where its own last piece
may end (its exits): a small matrix over (max, +).  Matrices are multiplied in a tree, which gives
every chunk the scores of its entries; then each chunk knows which entry each exit comes from, these
maps are composed in a second tree, and each chunk is traced back on its own.  Scores are integers,
so the outcome is that of one pass over the whole text, ties included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 32_768  # characters
FAN = 64  # chunks that are combined in one task
SCALE = 1024  # scores are whole multiples of 1 / SCALE
LOW = -(1 << 60)  # stands for minus infinity
SEGMENT = 400  # characters that the library searches at once: at most 500 penalties of 30.8 stay below 2**24 / SCALE


def unigram_model(pieces: list[str], scores: list[int], plain: set[str], byte_ids: set[int], unknown: int) -> bytes:
    """A model file of kind unigram with these pieces and scores, and texts taken as they are.

    Fields of the file format: 1 a piece (1 text, 2 score, 3 kind: 1 normal, 2 unknown, 3 control, 6
    byte), 2 the trainer (3 kind of model, 35 bytes for unknown characters), 3 the normalizer.
    """

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(at: int, value) -> bytes:
        if isinstance(value, int):
            return number(at << 3) + number(value)
        if isinstance(value, np.float32):
            return number(at << 3 | 5) + value.tobytes()
        return number(at << 3 | 2) + number(len(value)) + value

    body = b"".join(
        field(1, field(1, p.encode()) + field(2, np.float32(scores[i] / SCALE)) + field(3, 2 if i == unknown else 6 if i in byte_ids else 1 if p in plain else 3))
        for i, p in enumerate(pieces))
    trainer = field(3, 1) + field(35, int(bool(byte_ids)))
    return body + field(2, trainer) + field(3, field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0))


class Vocabulary:
    """Pieces with whole scores: what a worker needs of a model."""

    def __init__(self, pieces: list[str], scores: list[int], byte_ids: list[int], unknown: int):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        self.table = {p: (i, s) for i, (p, s) in enumerate(zip(pieces, scores)) if s is not None}
        self.longest = max(map(len, self.table), default=1)
        self.penalty = min((s for s in scores if s is not None), default=0) - 10 * SCALE
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        # a space that follows a character cannot stand within a piece: words are independent
        self.cuts = not any(inner.search(p) for p in self.table)
        self.reach: dict[str, int] = {}  # longest piece by its first two characters
        for p in self.table:
            if len(p) > 1:
                self.reach[p[:2]] = max(self.reach.get(p[:2], 0), len(p))
        self.bytes_of = {i: n for n, i in enumerate(byte_ids)}
        self.model = unigram_model(pieces, [s or 0 for s in scores], set(self.table), set(self.bytes_of), unknown)
        # cost of each id: an unknown character counts once, at the first of its bytes
        self.costs = np.array([s or 0 for s in scores], dtype=np.int64)
        for i, byte in self.bytes_of.items():
            self.costs[i] = self.penalty if byte & 0xC0 != 0x80 else 0
        self.library = None

    def __getstate__(self):
        return {**self.__dict__, "library": None}

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments of up to ``SEGMENT`` + 1 characters, whose scores the library's floats hold exactly."""
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self.library.encode(segments, num_threads=1)

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.table.get(piece)
        if found:
            return (found[0],)
        return tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown,)


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Vocabulary of a model file.

    A unigram model's scores are log probabilities.  A merge model's are ranks, from which they are
    set to -log(rank + 1) (Zipf), as no corpus may be used to fit them.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
    own = [model.get_score(i) for i in range(size)]
    ranks = all(s == int(s) for s, p in zip(own, plain) if p)
    scores = [(round(SCALE * (-math.log(1 - s) if ranks else s)) if p else None) for s, p in zip(own, plain)]
    by_name = {f"<0x{b:02X}>": b for b in range(256)}
    byte_ids = [0] * 256
    for i in range(size):
        if model.is_byte(i):
            byte_ids[by_name[model.id_to_piece(i)]] = i
    return Vocabulary([model.id_to_piece(i) for i in range(size)], scores, byte_ids if any(byte_ids) else [], max(model.unk_id(), 0))


def forward(v: Vocabulary, text: str, best: list[int], end: int) -> list[int]:
    """Best scores of all places, and where the last piece before each began (-1: an entry).

    ``best`` holds the scores of entries and has one place per place of ``text``; only pieces that
    begin before ``end`` are used.  At equal scores the earlier beginning stays.
    """
    n, table, reach, penalty = len(text), v.table, v.reach, v.penalty
    came = [-1] * len(best)
    for start in range(end):
        here = best[start]
        if here <= LOW:
            continue
        found = table.get(text[start])
        score = here + (found[1] if found else penalty)
        if score > best[start + 1]:
            best[start + 1], came[start + 1] = score, start
        for stop in range(start + 2, min(n, start + reach.get(text[start : start + 2], 0)) + 1):
            found = table.get(text[start:stop])
            if found and here + found[1] > best[stop]:
                best[stop], came[stop] = here + found[1], start
    return came


def trace(v: Vocabulary, text: str, came: list[int], end: int) -> tuple[int, list[int]]:
    """Entry from which the best way reaches ``end``, and its piece ids."""
    out = []
    while came[end] >= 0:
        start = came[end]
        out.append(v.ids(text[start:end]))
        end = start
    return end, [i for ids in reversed(out) for i in ids]


#: As many whole words as fit a segment, or one longer word.
_SEGMENT = re.compile(f"(?s){SPACE}.{{0,{SEGMENT}}}(?=(?<!{SPACE}){SPACE}|\\Z)|{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def normal(text: str) -> str:
    """Spaces as marks, with one before the text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_texts(v: Vocabulary, texts) -> list[list[int]]:
    """Ids of whole texts, by segments of words where pieces cannot span words."""
    return [_ids(v, marked, 0, len(marked)) for marked in map(normal, texts)]


def _ids(v: Vocabulary, marked: str, first: int, last: int) -> list[int]:
    """Ids of a part between two cuts.  Words longer than a segment are searched here."""
    if not (v.cuts and v.byte_ids):
        return _whole(v, marked[first:last])
    segments = _SEGMENT.findall(marked, first, last)
    if any(len(s) > SEGMENT + 1 for s in segments):
        return list(chain.from_iterable(v.encode([s])[0] if len(s) <= SEGMENT + 1 else _whole(v, s) for s in segments))
    return list(chain.from_iterable(v.encode(segments)))


def _whole(v: Vocabulary, marked: str) -> list[int]:
    best = [0] + [LOW] * len(marked)
    return trace(v, marked, forward(v, marked, best, len(marked)), len(marked))[1]


def encode_text(v: Vocabulary, text: str) -> list[int]:
    return encode_texts(v, [text])[0]


def _ends(v: Vocabulary, text: str, size: int) -> tuple[int, int] | None:
    """First cut behind all entries and last cut of the chunk, if there are such."""
    if not v.cuts:
        return None
    first = _CUT.search(text, min(v.longest, size), size + 1)
    if first is None or first.start() > size:
        return None
    last = first.start()
    at = text.rfind(SPACE, last, size)
    while at > last and text[at - 1] == SPACE:
        at -= 1
    return first.start(), max(at, last)


def transfer(v: Vocabulary, text: str, size: int) -> np.ndarray:
    """Entries x exits of a chunk of ``size`` characters, of which ``text`` also holds the next few."""
    n, width = len(text), v.longest
    out = np.full((width, width), LOW, dtype=np.int64)
    cut = _ends(v, text, size)

    def exits(best):
        return np.array([best[size + e] if size + e <= n else LOW for e in range(width)], dtype=np.int64)

    if cut:
        first, last = cut
        middle = int(v.costs[_ids(v, text, first, last)].sum())
        best = [LOW] * last + [0] + [LOW] * (n - last)
        forward(v, text, best, size)
        tail = exits(best)
        for i in range(min(width, first + 1)):
            best = [LOW] * i + [0] + [LOW] * (first - i)
            forward(v, text[:first], best, first)
            out[i] = np.where(tail > LOW, tail + middle + best[first], LOW) if best[first] > LOW else LOW
    else:
        for i in range(min(width, size + 1)):
            best = [LOW] * i + [0] + [LOW] * (n - i)
            forward(v, text, best, size)
            out[i] = exits(best)
    for i in range(size, width):  # an entry behind a short chunk is an exit as it is
        if 0 <= i - size < width:
            out[i] = LOW
            out[i, i - size] = 0
    return out


def chunk_ids(v: Vocabulary, text: str, size: int, entry: np.ndarray) -> tuple[np.ndarray, callable]:
    """Entry that each exit comes from, and a function from an exit to the ids of the pieces that begin here."""
    n, width = len(text), v.longest
    cut = _ends(v, text, size)
    if cut:
        first, last = cut
        head = [int(entry[i]) if i < width else LOW for i in range(first + 1)]
        came_head = forward(v, text[:first], head, first)
        start, ids_head = trace(v, text[:first], came_head, first)
        tail = [LOW] * last + [0] + [LOW] * (n - last)
        came_tail = forward(v, text, tail, size)
        came_from = np.array([start if size + e <= n and tail[size + e] > LOW else -1 for e in range(width)], dtype=np.int64)
        return came_from, lambda e: ids_head + _ids(v, text, first, last) + trace(v, text, came_tail, size + e)[1]
    best = [int(entry[i]) if i < width else LOW for i in range(n + 1)]
    came = forward(v, text, best, size)
    ways = [trace(v, text, came, size + e) if size + e <= n and best[size + e] > LOW else (-1, []) for e in range(width)]
    return np.array([i for i, _ in ways], dtype=np.int64), lambda e: ways[e][1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over (max, +): the best way through ``a``, then ``b``."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), LOW)


# --- Spark ------------------------------------------------------------------------------------------------

_KEY = "uid string, doc bigint, place bigint"


def _chunks(batches: Iterator[pd.DataFrame], size: int, ahead: int) -> Iterator[pd.DataFrame]:
    pid, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for doc, text in zip(batch["id"], batch["text"]):
            marked = normal(text)
            count, n = -(-len(marked) // size), n + 1
            for at in range(0, count, FAN):
                yield pd.DataFrame([(f"{pid}-{n}", doc, k, count, marked[k * size : (k + 1) * size + ahead], min(size, len(marked) - k * size))
                                    for k in range(at, min(count, at + FAN))], columns=["uid", "doc", "place", "n_chunks", "text", "size"])


def _scan(level0: DataFrame, join, step, first: bytes, back: bool, name: str) -> DataFrame:
    """Value that reaches each chunk of each document: (uid, place, got).

    ``level0`` has (uid, place, top, m); ``join(list of m)`` combines neighbours, ``step(value, m)``
    carries a value over one.  ``back`` runs from the last chunk to the first.  Groups have ``FAN``
    members on every level, and there are as many levels as a document of the most chunks needs.
    """
    def up(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({"uid": [frame["uid"].iloc[0]], "place": [int(frame["place"].iloc[0]) // FAN], "top": [int(frame["top"].iloc[0]) // FAN],
                             "m": [join(list(frame["m"]))]})

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", ascending=not back)
        got, value = [], frame["value"].iloc[0]
        for m in frame["m"]:
            got.append(value)
            value = step(value, m)
        return pd.DataFrame({"uid": frame["uid"], "place": frame["place"], "got": got})

    schema = "uid string, place bigint, top bigint, m binary"
    levels = [level0]
    most = level0.agg(F.max("top")).first()[0]
    while most:
        most //= FAN
        levels.append(stored(levels[-1].groupBy("uid", F.floor(F.col("place") / FAN)).applyInPandas(up, schema), name))
    got = levels[-1].select("uid", "place", F.lit(first).alias("got"))
    for level in reversed(levels[:-1]):
        above = got.select(F.col("uid").alias("_uid"), F.col("place").alias("_above"), F.col("got").alias("value"))
        joined = level.join(above, (F.col("uid") == F.col("_uid")) & (F.floor(F.col("place") / FAN) == F.col("_above")))
        got = stored(joined.groupBy("uid", "_above").applyInPandas(down, "uid string, place bigint, got binary"), name)
    return got


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, chunk, n_chunks, ids): the pieces of each text, a row per chunk of ``chunk`` characters.

    Texts up to ``chunk`` characters are one row and are encoded where they lie; longer ones become
    chunks, of which only small matrices and maps travel between tasks.  A piece belongs to the chunk
    in which it begins.  NULL and empty texts have one row without pieces; repeated rows are encoded
    each; U+2581 in a text is taken for a space; other columns are not read.
    """
    if chunk < vocabulary.longest:
        raise ValueError("chunk must be at least as long as the longest piece")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)  # a model's vocabulary: its size is that of the file
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width, ahead = vocabulary.longest, vocabulary.longest - 1
    out = f"{id_col} bigint, chunk bigint, n_chunks bigint, ids array<int>"

    def short(batches):
        v = sent.value
        for batch in batches:
            yield pd.DataFrame({id_col: batch["id"], "chunk": 0, "n_chunks": 1, "ids": encode_texts(v, batch["text"])})

    # one place is the mark before the text
    direct = rows.filter(F.length("text") < chunk).mapInPandas(short, out)
    long = rows.filter(F.length("text") >= chunk).mapInPandas(lambda b: _chunks(b, chunk, ahead), f"{_KEY}, n_chunks bigint, text string, size bigint")
    parts = stored(long, "chunks")

    def matrices(batches):
        v = sent.value
        for batch in batches:
            yield pd.DataFrame({"uid": batch["uid"], "place": batch["place"], "top": batch["n_chunks"] - 1,
                                "m": [transfer(v, t, int(s)).tobytes() for t, s in zip(batch["text"], batch["size"])]})

    def matrix(m: bytes) -> np.ndarray:
        return np.frombuffer(m, dtype=np.int64).reshape(width, width)

    def multiply(items: list[bytes]) -> bytes:
        total = matrix(items[0])
        for m in items[1:]:
            total = product(total, matrix(m))
        return total.tobytes()

    def carry(value: bytes, m: bytes) -> bytes:
        return np.maximum((np.frombuffer(value, dtype=np.int64)[:, None] + matrix(m)).max(0), LOW).tobytes()

    level0 = "uid string, place bigint, top bigint, m binary"
    start = np.full(width, LOW, dtype=np.int64)
    start[0] = 0
    entries = _scan(stored(parts.mapInPandas(matrices, level0), "matrices"), multiply, carry, start.tobytes(), False, "entries")
    known = parts.join(entries.withColumnRenamed("got", "entry"), ["uid", "place"])

    def sources(batches):
        v = sent.value
        for batch in batches:
            yield pd.DataFrame({"uid": batch["uid"], "place": batch["place"], "top": batch["n_chunks"] - 1,
                                "m": [chunk_ids(v, t, int(s), np.frombuffer(e, dtype=np.int64))[0].tobytes()
                                      for t, s, e in zip(batch["text"], batch["size"], batch["entry"])]})

    def follow(items: list[bytes]) -> bytes:
        total = np.arange(width, dtype=np.int64)
        for m in reversed(items):
            total = np.where(total >= 0, np.frombuffer(m, dtype=np.int64)[total], -1)
        return total.tobytes()

    def back(value: bytes, m: bytes) -> bytes:
        return np.frombuffer(m, dtype=np.int64)[np.frombuffer(value, dtype=np.int64)].tobytes()

    exits = _scan(stored(known.mapInPandas(sources, level0), "sources"), follow, back, np.zeros(1, dtype=np.int64).tobytes(), True, "exits")

    def traced(batches):
        v = sent.value
        for batch in batches:
            ids = [chunk_ids(v, t, int(s), np.frombuffer(e, dtype=np.int64))[1](int(np.frombuffer(x, dtype=np.int64)[0]))
                   for t, s, e, x in zip(batch["text"], batch["size"], batch["entry"], batch["exit"])]
            yield pd.DataFrame({id_col: batch["doc"], "chunk": batch["place"], "n_chunks": batch["n_chunks"], "ids": ids})

    both = direct.unionByName(known.join(exits.withColumnRenamed("got", "exit"), ["uid", "place"]).mapInPandas(traced, out))
    return both.select(hollow(id_col).alias(id_col), "chunk", "n_chunks", "ids")


def decode_ids(v: Vocabulary, ids, first: bool) -> str:
    """Text of piece ids; the mark before the text is taken away from a ``first`` chunk."""
    if v.bytes_of.keys().isdisjoint(ids):
        text = "".join(map(v.pieces.__getitem__, ids)).replace(SPACE, " ")
        return text[1:] if first and text[:1] == " " else text
    out, pending = [], bytearray()
    for i in ids:
        byte = v.bytes_of.get(i)
        if byte is not None:
            pending.append(byte)
            continue
        if pending:
            out.append(pending.decode("utf-8", "replace"))
            pending = bytearray()
        out.append(v.pieces[i])
    if pending:
        out.append(pending.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if first and text[:1] == " " else text


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``text``: what each chunk's ids stand for; a document's chunks in order are its text.  NULL ids are none."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(ids: pd.Series, chunk: pd.Series) -> pd.Series:
        v = sent.value
        return pd.Series([decode_ids(v, [] if i is None else i.tolist(), c == 0) for i, c in zip(ids, chunk)], dtype=object)

    return encoded.withColumn("text", text("ids", "chunk"))
