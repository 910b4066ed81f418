"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, so its tables hold what languages share and not every rare word; they
grow far slower than the corpus and are never sent anywhere whole.  Documents are packed into
compressed blocks; a block asks for the chances of its distinct n-grams, which meet the sharded counts
in joins by n-gram, and gets them back as lists.

One model per fold of the trusted documents is trained on the others.  That without fold 0 gives all
perplexities; each trusted document is also scored by the model without its own fold, and these
cross-fitted perplexities set the thresholds.
"""

from __future__ import annotations

import bz2
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import bucketed, hollow, solid, stored

ORDER = 4
BLOCK = 32_000_000  # characters of a block: the larger, the fewer blocks ask for the same n-gram
PIECE = 1_000_000  # characters of a document that stay together
START = 2  # stands before the first character
#: A table of trusted ids of up to this many rows is sent to all executors; a larger one is joined.
MOST_BROADCAST_IDS = 1_000_000
QUANTILE = 0.99  # of the cross-fitted trusted documents
SHRINK = 30  # a language with so many trusted documents weighs its own spread and that of all languages alike
FOLDS = 5  # models, each trained without one part of the trusted documents
LEAST_DISCOUNT = 0.1  # keeps every chance above 0 where counts are too few for the formula


def grams(codes: np.ndarray) -> np.ndarray:
    """Each character with the three before it, 16 bits each (beyond U+FFFF: the lower 16)."""
    c = codes.astype(np.uint64) & np.uint64(0xFFFF)
    return ((c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as (block, blob, and lists of their pieces' row numbers, lengths and folds); a piece begins with the characters before it."""
    pid, number = TaskContext.get().partitionId(), 0
    texts, meta, size = [], [], 0

    def frame():
        blob = bz2.compress("".join(texts).encode("utf-8", "surrogatepass"))  # blocks are moved: size counts more than time
        return pd.DataFrame({"block": [(pid << 32) + number], "blob": [blob], "rows": [[m[0] for m in meta]],
                             "lens": [[m[1] for m in meta]], "folds": [[m[2] for m in meta]]})

    for batch in batches:
        for row_id, text, fold in zip(batch["row_id"], batch["text"], batch["fold"]):
            for at in range(0, max(len(text), 1), PIECE):
                piece = (text[at - ORDER + 1 : at + PIECE] if at else chr(START) * (ORDER - 1) + text[:PIECE])
                texts.append(piece)
                meta.append((row_id, len(piece), int(fold)))
                size += len(piece)
                if size >= BLOCK:
                    yield frame()
                    texts, meta, size, number = [], [], 0, number + 1
    if meta:
        yield frame()


def _unpacked(blob: bytes, lens) -> Iterator[np.ndarray]:
    text, at = bz2.decompress(blob).decode("utf-8", "surrogatepass"), 0
    for n in lens:
        yield _codes(text[at : at + n])
        at += n


class _Tally:
    """Numbers of distinct n-grams, counted every few million."""

    def __init__(self):
        self.fresh, self.size, self.counted = [], 0, []

    def add(self, codes: np.ndarray):
        self.fresh.append(grams(codes))
        self.size += len(codes)
        if self.size >= 2 * PIECE:
            self._count()

    def _count(self):
        if self.fresh:
            self.counted.append(np.unique(np.concatenate(self.fresh), return_counts=True))
            self.fresh, self.size = [], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        if not self.counted:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, at = np.unique(np.concatenate([g for g, _ in self.counted]), return_inverse=True)
        return found, np.bincount(at, weights=np.concatenate([n for _, n in self.counted]), minlength=len(found)).astype(np.int64)


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, block, n0, n1, ...): the distinct n-grams of a block, with their number in the trusted documents of each fold."""
    for batch in batches:
        for block, blob, lens, folds in zip(batch["block"], batch["blob"], batch["lens"], batch["folds"]):
            tallies = [_Tally() for _ in range(FOLDS + 1)]  # the last of documents without trust
            for codes, fold in zip(_unpacked(blob, lens), folds):
                tallies[fold].add(codes)
            parts = [tally.total() for tally in tallies]
            found = np.unique(np.concatenate([g for g, _ in parts]))
            out = {"gram": found, "block": block}
            for k, (own, n) in enumerate(parts[:FOLDS]):
                out[f"n{k}"] = np.zeros(len(found), dtype=np.int64)
                out[f"n{k}"][np.searchsorted(found, own)] = n
            yield pd.DataFrame(out)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row_id, total, crossed, n): sums of log chances of the pieces of a block, by the model without fold 0 and by that without their own."""
    for batch in batches:
        logs_of = zip(*[batch[f"logs{k}"] for k in range(FOLDS)])
        for blob, lens, rows, folds, known, logs in zip(batch["blob"], batch["lens"], batch["rows"], batch["folds"], batch["grams"], logs_of):
            order = np.argsort(known)
            known, logs = np.asarray(known)[order], [np.asarray(x, dtype=np.float64)[order] for x in logs]
            totals, crossed, counts = [], [], []
            for codes, fold in zip(_unpacked(blob, lens), folds):
                own = np.sort(grams(codes))  # in order they are found faster, and a sum needs none
                at = np.searchsorted(known, own)
                totals.append(float(logs[0][at].sum()) if len(own) else 0.0)
                crossed.append(float(logs[fold][at].sum()) if len(own) and fold > 0 else totals[-1])
                counts.append(len(own))
            yield pd.DataFrame({"row_id": rows, "total": totals, "crossed": crossed, "n": counts})


def _context(gram: Column) -> Column:
    """All characters of an n-gram but the last."""
    return F.shiftrightunsigned(gram, 16)


def _tail(gram: Column, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << (16 * order)) - 1)) if order < 4 else gram


def model_tables(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], dict[int, int]]:
    """Per order 1..ORDER: (model, gram, seen) and (model, context, total, back), from counts (model, gram, n) of the highest
    order; and the number of characters that each model has seen.

    ``seen`` is the discounted count, ``total`` that of the context, ``back`` what its lower order
    weighs.  Lower orders count the distinct characters before an n-gram.  Discounts of counts 1, 2
    and 3 or more come from the numbers of n-grams seen 1 to 4 times.
    """
    seen, contexts, letters = [], [], {}
    level = counts
    for order in range(ORDER, 0, -1):
        level = stored(level, f"grams{order}")
        of = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        cuts = [(0.5, 1.0, 1.5)] * FOLDS
        for model, n1, n2, n3, n4, size in level.groupBy("model").agg(*of, F.count("*")).collect():
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
            cuts[model] = tuple(min(max(k - (k + 1) * y * b / a, LEAST_DISCOUNT), float(k)) if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
            letters[model] = size  # that of the last order, 1, stays
        cut = [F.element_at(F.array(*[F.lit(c[k]) for c in cuts]), F.col("model") + 1) for k in range(3)]
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        seen.append(level.select("model", F.col("gram").alias(f"g{order}"), (F.col("n") - discount).alias(f"seen{order}")))
        contexts.append(level.groupBy("model", _context(F.col("gram")).alias(f"c{order}")).agg(
            F.sum("n").cast("double").alias(f"total{order}"), F.sum(discount).alias(f"back{order}")))
        level = level.groupBy("model", _tail(F.col("gram"), order - 1).alias("gram")).agg(F.count("*").alias("n"))
    return seen[::-1], contexts[::-1], letters


def chances(totals: DataFrame) -> tuple[DataFrame, list[int]]:
    """(gram, log0, log1, ...): natural logarithm of the chance of each n-gram's last character after the others, by the model
    without each fold; and the models that have text.  ``totals`` has the numbers n0, n1, ... of each n-gram by fold."""
    every = sum(F.col(f"n{k}") for k in range(FOLDS))
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), (every - F.col(f"n{k}")).alias("n")) for k in range(FOLDS)])).alias("m")
    asked = totals.select("gram", of).select("m.model", "gram", "m.n")
    seen, contexts, letters = model_tables(asked.filter("n > 0"))
    # a model's fold asks only for n-grams that it has; all documents ask that without fold 0
    table = totals.select("gram", F.explode(F.filter(F.array(F.lit(0), *[F.when(F.col(f"n{k}") > 0, k) for k in range(1, FOLDS)]), lambda k: k.isNotNull())).alias("model"))
    for order in range(ORDER, 0, -1):
        table = table.withColumn(f"g{order}", _tail(F.col("gram"), order)).withColumn(f"c{order}", _context(F.col(f"g{order}")))
        table = table.join(seen[order - 1], ["model", f"g{order}"], "left").join(contexts[order - 1], ["model", f"c{order}"], "left")
    p = F.element_at(F.array(*[F.lit(1.0 / (letters.get(k, 0) + 1)) for k in range(FOLDS)]), F.col("model") + 1)  # one letter for all that were never seen
    for order in range(1, ORDER + 1):
        total = F.col(f"total{order}")
        p = F.when(total.isNull(), p).otherwise((F.coalesce(f"seen{order}", F.lit(0.0)) + F.col(f"back{order}") * p) / total)
    logs = table.select("gram", "model", F.ln(p).cast("float").alias("log"))
    by_model = [F.max(F.when(F.col("model") == k, F.col("log"))).alias(f"log{k}") for k in range(FOLDS)]
    return logs.groupBy("gram").agg(*by_model), sorted(letters)


def perplexities(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(row_id, n_chars, perplexity, crossed) of rows (row_id, text, fold), and the folds whose model has text.

    ``fold`` is -1 for documents without trust.  ``perplexity`` is under the model without fold 0, and
    ``crossed`` under that without the document's fold.
    """
    blocks = bucketed(rows.select("row_id", "text", "fold").mapInPandas(
        _blocks, "block bigint, blob binary, rows array<bigint>, lens array<bigint>, folds array<int>"), "block", "blocks")
    numbers = [f"n{k}" for k in range(FOLDS)]
    asked = stored(blocks.mapInPandas(_asked, "gram bigint, block bigint, " + ", ".join(f"{n} bigint" for n in numbers)), "asked")
    totals = stored(asked.groupBy("gram").agg(*[F.sum(n).alias(n) for n in numbers]), "counts")
    logs, models = chances(totals)
    logs = stored(logs, "chances")
    # one number says which folds have the n-gram
    has = sum((F.when(F.col(n) > 0, 1 << k).otherwise(0) for k, n in enumerate(numbers) if k), F.lit(1))
    answered = asked.select("gram", "block", has.alias("has")).join(logs, "gram")
    own = [F.when(F.col("has").bitwiseAND(1 << k) > 0, F.col(f"log{k}")).otherwise(F.lit(0.0).cast("float")).alias(f"log{k}") for k in range(FOLDS)]
    answers = answered.groupBy("block").agg(F.collect_list(F.struct("gram", *own)).alias("l"))
    answers = answers.select(F.col("block").alias("_block"), F.col("l.gram").alias("grams"), *[F.col(f"l.log{k}").alias(f"logs{k}") for k in range(FOLDS)])
    scored = blocks.join(answers, F.col("block") == F.col("_block"), "left").mapInPandas(_scored, "row_id bigint, total double, crossed double, n bigint")
    scored = scored.groupBy("row_id").agg(*[F.sum(c).alias(c) for c in ("total", "crossed", "n")])
    per_char = lambda c: F.when(F.col("n") > 0, F.exp(-F.col(c) / F.col("n")))
    return scored.select("row_id", F.col("n").alias("n_chars"), per_char("total").alias("perplexity"), per_char("crossed").alias("crossed")), models


def fold_of(id_col: str | Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


def held_out(id_col: str | Column) -> Column:
    return fold_of(id_col) == 0


def thresholds(of: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang, limit) and the limit of all languages together, from (lang, crossed) of trusted documents.

    On logarithms, a language's limit is its median and, above it, the quantile of its own distances to
    the median and that of all languages' distances to theirs, weighed as its number of documents and
    SHRINK.  So each language with trusted text has its own limit, and no number of documents where it jumps.
    """
    at = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(10_000))
    of = of.select(F.col("lang"), F.ln("crossed").alias("x"))
    own = stored(of.groupBy("lang").agg(at("x", 0.5).alias("middle"), at("x", quantile).alias("high"), F.count("*").alias("m")), "middles")
    own = own.select(F.col("lang").alias("_lang"), "middle", "high", "m")
    pooled, spread = of.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("_lang"))).agg(at("x", quantile), at(F.col("x") - F.col("middle"), quantile)).first()
    over = (F.col("m") * (F.col("high") - F.col("middle")) + SHRINK * F.lit(spread).cast("double")) / (F.col("m") + SHRINK)
    return own.select("_lang", F.exp(F.col("middle") + over).alias("limit")), None if pooled is None else math.exp(pooled)


def judge_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  quantile: float = QUANTILE, margin: float = 1.0) -> DataFrame:
    """(id_col, lang, n_chars, perplexity, threshold, kept, text_hash), one row per input row.

    ``trusted`` names the ids of trusted documents, which a hash of the id deals into FOLDS folds.  The
    model trained on all folds but the first gives the perplexities.  All trusted documents, each under
    a model that was not trained on its fold, set the thresholds: the given quantile for each language,
    drawn towards the spread of all languages the more the fewer they are, times ``margin``; a language
    without trusted text takes the quantile of all.  A document is kept
    unless its perplexity is above; documents without text (NULL or empty) have none and are not
    kept, and without any trusted text all others are kept.  Repeated rows are judged alike, NULL
    ids are never trusted, a NULL language is a language.  Other columns are not read.
    """
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    good = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("_good")).filter("_good IS NOT NULL").distinct()
    good = F.broadcast(good) if good.count() <= MOST_BROADCAST_IDS else good
    marked = rows.join(good, F.col("id") == F.col("_good"), "left").select(
        F.xxhash64("id", "text", "lang").alias("row_id"), "id", "lang", "text", F.when(F.col("_good").isNotNull(), fold_of("id")).otherwise(-1).alias("fold"))
    heads = stored(marked.select("row_id", "id", "lang", "fold", F.xxhash64("text").alias("text_hash")), "heads")
    # equal rows have one number and get the same answer: their sums over characters are of the same ratio
    scores, models = perplexities(marked)
    scored = stored(heads.join(scores.withColumnRenamed("row_id", "_row"), F.col("row_id") == F.col("_row")), "scores")
    per_language, everywhere = thresholds(scored.filter(F.col("fold").isin(models) & F.col("crossed").isNotNull()), quantile)
    threshold = F.coalesce(F.col("limit"), F.lit(everywhere).cast("double")) * margin
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return scored.join(per_language, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        hollow().alias(id_col), "lang", "n_chars", "perplexity", threshold.alias("threshold"), kept.alias("kept"), "text_hash")
