"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base kinds.
ADDED_KINDS = ("secret", "number", "address")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Candidates of the added kinds.
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|token|pin)\s?[:=]\s?(\S{4,})")
_NUMBER = re.compile(r"(?<![0-9.+-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{4})(?![0-9-])")
_ADDRESS = re.compile(r"(?i) ?[\[(]at[\])] ?[a-z0-9-]{2,}+(?: ?[\[(]dot[\])] ?[a-z0-9-]{2,}+|\.[a-z0-9-]{2,}+)+")
_SPELLED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._")  # before the sign of an _ADDRESS

#: Word lists of the gazetteer and context labelers.
DOMAINS = frozenset("com org net edu gov info example mail gmail yahoo hotmail outlook".split())
SECRET_NAMES = frozenset("password passwd pwd secret api_key api-key apikey".split())
CONTEXT = frozenset("call phone tel telephone fax mobile contact mail email e-mail write card account ssn social login user credentials".split())
AGAINST = frozenset("isbn issn version page figure table serial order invoice".split())
REACH = 40  # characters of context on either side
CLOSING = re.compile(r"[.,;:!?)\]}>\"']*")  # what is left of a secret after a base span, if it is this and no more, ends the sentence

YES, NO, NONE = 1, 0, 2
LABELERS = ("shape", "digits", "gazetteer", "context", "variety")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (1 + place % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in linear time: only signs ``@`` are looked at."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each base kind; matches that fail their test are dropped."""
    found = {kind: [] for kind in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Spelled-out addresses of any length: from each sign ``[at]`` back over what can stand before it, two characters at least."""
    found, free = [], 0
    for m in _ADDRESS.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _SPELLED:
            start -= 1
        while start < m.start() and text[start] == ".":
            start += 1
        if m.start() - start >= 2:
            found.append((start, m.end()))
            free = m.end()
    return found


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Spans of the added kinds beside the base spans, leftmost first per kind, each with the span that is voted on.

    A secret runs to the next white space.  Base spans within it stay, its parts beside them are spans and
    the votes are on the whole; other candidates that overlap a base span are none.
    """
    out = []
    taken = sorted(taken)
    starts, found = [a for a, _ in taken], []
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        found += [("number", *m.span()) for m in _NUMBER.finditer(text)]
    if "[" in text or "(" in text:
        found += [("address", *span) for span in addresses(text)]
    for kind, start, end in found:
        at = bisect_right(starts, start)
        free = start
        while at and taken[at - 1][1] > free:  # base spans may lie within each other
            free, at = taken[at - 1][1], at - 1
        at = bisect_right(starts, start)
        if kind != "secret" and (free > start or (at < len(taken) and taken[at][0] < end)):
            continue
        beside = free > start
        while at < len(taken) and taken[at][0] < end:
            if taken[at][0] > free:
                out.append((kind, free, taken[at][0], start, end))
            free, beside, at = max(free, taken[at][1]), True, at + 1
        if free < end and not (beside and CLOSING.fullmatch(text, free, end)):
            out.append((kind, free, end, start, end))
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: yes, no or none."""
    span, before = text[start:end], text[max(0, start - REACH) : start].lower()
    around = set(re.findall(r"[a-z][a-z-]+", before + " " + text[end : end + REACH].lower()))
    digits = sum(c.isdigit() for c in span)
    share = digits / max(1, len(span))
    if kind == "secret":
        name = re.search(r"([a-z_-]+)\s?[:=]\s?$", before)
        return (YES if len(span) >= 6 else NO, YES if digits and digits < len(span) else NONE, YES if name and name.group(1) in SECRET_NAMES else NO,
                YES if around & CONTEXT else NO if around & AGAINST else NONE, YES if len(set(span)) >= 5 else NO)
    if kind == "number":
        shaped = re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}", span)
        return (YES if shaped else NO, YES if share > 0.7 else NO, NONE,
                NO if around & AGAINST else YES if around & CONTEXT else NONE, YES if len(set(span)) >= 5 else NO)
    words = re.findall(r"[a-z]+", span.lower())
    return (YES if len(words) >= 4 else NONE, NO if share > 0.5 else NONE, YES if DOMAINS & set(words[1:]) else NO,
            YES if around & CONTEXT else NO if around & AGAINST else NONE, YES if len(set(span)) >= 5 else NO)


def features(kind: str, length: int, ballot: tuple[int, ...]) -> tuple[int, ...]:
    """Bounded marks of a span: kind, length class, votes."""
    return (KINDS.index(kind), min(length.bit_length(), 7), *ballot)


def _columns(marks: np.ndarray) -> np.ndarray:
    """Marks as a 0/1 matrix with a leading one."""
    sizes = (len(KINDS), 8, *(3,) * len(LABELERS))
    return np.concatenate([np.ones((len(marks), 1)), *[np.eye(s)[marks[:, i]] for i, s in enumerate(sizes)]], axis=1)


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over the distinct ballots and how often each was cast.

    Returns the share of true spans, the chance of each vote of each labeler for false and true spans
    (labeler x class x vote), and the chance that a span with each ballot is true.  It starts from
    the majority, and every count gets one vote more, so no chance is ever 0.
    """
    yes, no = (ballots == YES).sum(1), (ballots == NO).sum(1)
    p = (yes + 1.0) / (yes + no + 2.0)
    table = np.zeros((ballots.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        for j in range(ballots.shape[1]):
            for v in range(3):
                table[j, :, v] = weight[:, ballots[:, j] == v].sum(1) + 1.0
        table /= table.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        score = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, ballots[:, j]]) for j in range(ballots.shape[1]))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            p = new
            break
        p = new
    return prior, table, p


def fit_classifier(marks: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; ``ridge`` keeps weights of rare marks small."""
    x = _columns(marks)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (target - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


_SPAN = "struct<kind:string,start:bigint,end:bigint,marks:array<int>>"
_FOUND = f"id bigint, base array<{_SPAN}>, more array<{_SPAN}>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, base, more = [], [], []
        for doc, text in zip(batch["id"], batch["text"]):
            spans = base_spans(text)
            flat = [(kind, a, b) for kind in BASE_KINDS for a, b in spans[kind]]
            added = candidates(text, [(a, b) for _, a, b in flat])
            ids.append(doc)
            base.append([{"kind": k, "start": a, "end": b, "marks": []} for k, a, b in flat])
            more.append([{"kind": k, "start": a, "end": b, "marks": list(features(k, d - c, votes(text, k, c, d)))} for k, a, b, c, d in added])
        yield pd.DataFrame({"id": ids, "base": base, "more": more})


def fitted(found: DataFrame) -> dict[tuple[int, ...], float]:
    """Chance of being personal data for each combination of marks in the corpus.

    All candidates are counted; what reaches the driver is one row per combination of marks, and
    there are at most 3 kinds x 8 length classes x 3**5 ballots of these.
    """
    counted = found.select(F.explode("more").alias("m")).groupBy(F.col("m.marks").alias("marks")).agg(F.count("*").alias("n"))
    rows = [(tuple(r["marks"]), r["n"]) for r in counted.orderBy("marks").collect()]
    if not rows:
        return {}
    marks, counts = np.array([m for m, _ in rows]), np.array([n for _, n in rows], dtype=float)
    _, _, truth = reliabilities(marks[:, 2:], counts)
    w = fit_classifier(marks, truth, counts)
    chance = 1 / (1 + np.exp(-np.clip(_columns(marks) @ w, -30, 30)))
    return {m: float(c) for (m, _), c in zip(rows, chance)}


def _listed(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def _decide(chances: dict[tuple[int, ...], float], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, base, more in zip(batch["id"], batch["base"], batch["more"]):
                own = [(s["kind"], s["start"], s["end"]) for s in base]
                added = [(s["kind"], s["start"], s["end"]) for s in more if chances.get(tuple(int(v) for v in s["marks"]), 0.0) >= least]
                counts = [sum(k == kind for k, _, _ in own) for kind in BASE_KINDS]
                text = _listed(own)
                rows.append((doc, *counts, hashlib.sha256(text.encode()).hexdigest(), _listed(own + added)))
            yield pd.DataFrame(rows, columns=["id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    Base spans always stay.  Further candidates (secrets, numbers without a plus sign, spelled-out
    addresses) that overlap none of them are voted on by five labelers (shape, digits, gazetteer,
    context, variety); expectation-maximisation over all ballots of the corpus gives each ballot its
    chance of being true, these train a logistic span classifier, and spans of chance ``least`` or
    more are added.  The counts are those of base spans.  Spans are ``kind:start:end`` in code points,
    by kind and start.  NULL and empty texts have no spans; repeated rows are judged alike; other
    columns are not read.  Only numbers travel: a span's text stays in its partition.
    """
    found = stored(_rows(docs, id_col, text_col).mapInPandas(_find, _FOUND), "spans")
    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    decided = found.mapInPandas(_decide(fitted(found), least), f"id bigint, {counts}, base_sha256 string, spans string")
    return decided.select(hollow().alias(id_col), *decided.columns[1:])


def redacted_text(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, then the longest, counts."""
    out, last = [], 0
    listed = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)))
    for start, end, kind in listed:
        if start >= last:
            out += [text[last:start], f"<{kind.upper()}>"]
            last = -end
        elif -end > last:
            last = -end
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The same rows and columns, with all spans of ``personal_data`` in the text replaced by their kind.

    NULL texts stay NULL.  The classifier is fitted on all candidates first; texts are then changed
    where they lie, so no text is moved or joined.
    """
    more = _rows(docs, id_col, text_col).mapInPandas(_find, _FOUND).select("id", "more")
    chances = fitted(stored(more.filter(F.size("more") > 0), "spans"))

    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            own = [(kind, a, b) for kind, spans in base_spans(text).items() for a, b in spans]
            more = [(k, a, b) for k, a, b, c, d in candidates(text, [(a, b) for _, a, b in own])
                    if chances.get(features(k, d - c, votes(text, k, c, d)), 0.0) >= least]
            out.append(redacted_text(text, _listed(own + more)) if own or more else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, change(F.col(text_col)))
