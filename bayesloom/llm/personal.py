"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans follow fixed patterns and always stand. Other candidates are proposed by wide patterns
that also match much that is not personal (dates, long numbers, capitalised words after a title or
with a known first name). Six labelers vote for, against or not at all on each: strict forms (regular expressions),
gazetteers (names, places, issuers, countries, placeholder values), words before it, words around
it that speak of something else, checksums, and randomness. Expectation-maximisation over the
counted vote patterns of the whole corpus estimates each labeler's reliability, by kind and over all
kinds, and each kind's share of true spans. Its posteriors are the soft labels that train a logistic classifier over the
votes, the shape of the span and the words around it, which accepts or rejects every candidate.

Only counts of (kind, votes), of which there is a fixed number, and the classifier's sample (at
most ``SAMPLE`` distinct candidates with their counts) reach the driver.

Cases: null or empty text has no spans; repeated rows are each answered; without candidates
only base spans are returned; an empty table gives no rows. Positions are code points, ends
exclusive. Other columns are ignored (``redact`` passes them on).
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, uniform

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "access_key", "secret", "masked_email", "ssn", "iban", "address", "birth_date", "person", "number")
#: Candidates that the classifier is trained on at most, and places of hashed features.
SAMPLE, PLACES = 10_000, 256

DIGIT = re.compile(r"[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that would start inside a run of digits fails where the run's start failed
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WIDER = {
    "access_key": re.compile(r"\b[A-Z]{4}[0-9A-Z]{16}\b"),
    "secret": re.compile(r"\b(?:password|passwd|pwd|token|secret|api_?key|key|code)\s{0,3}[=:]\s{0,3}\"?([^\s\"]{4,})", re.IGNORECASE),
    "masked_email": re.compile(r"\b[A-Za-z0-9._-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,64} ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,10}\b", re.IGNORECASE),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "address": re.compile(r"\b[0-9]{1,5} [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){0,2}\b|\b[A-Z][a-zäöüß]{1,20}(?:str\.|straße|strasse|weg|platz|gasse) [0-9]{1,4}\b"),
    "birth_date": re.compile(r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9-])"),
    "person": re.compile(r"\b(?!(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Dear)\b)[A-Z][a-zà-ÿ]{1,19} (?:[A-Z]\. )?[A-Z][a-zà-ÿ]{1,19}\b"),
    "number": re.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){6,18}(?![0-9])"),
}
#: What a text must hold for a pattern to be tried at all; each is no narrower than its pattern.
NEEDED = {
    "access_key": re.compile(r"[A-Z]{4}[0-9A-Z]"),
    "secret": re.compile(r"[=:]"),
    "masked_email": re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE),
    **dict.fromkeys(("ssn", "iban", "address", "birth_date", "number"), DIGIT),
}
STRICT = {
    "access_key": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]*[0-9][0-9A-Z]*"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z]).{8,}"),
    "masked_email": re.compile(r"[a-z0-9._-]+ ?[\[(] ?at ?[\])] ?[a-z0-9-]+ ?[\[(] ?dot ?[\])] ?[a-z]{2,4}", re.IGNORECASE),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}[ A-Z0-9]{8,}"),
    "address": re.compile(r".*(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Square|Place)|.*(?:str\.|straße|strasse|weg|platz|gasse) [0-9]+"),
    "birth_date": re.compile(r"19[3-9][0-9]-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./]19[3-9][0-9]"),
    "person": re.compile(r"[A-Z][a-zà-ÿ]{2,} (?:[A-Z]\. )?[A-Z][a-zà-ÿ]{2,}"),
    "number": re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[3-6][0-9]{13,15}"),
}
CONTEXT = {
    "secret": re.compile(r"\b(?:login|user|account|credential\w*|auth\w*|passw\w*|token|secret|api)\b", re.IGNORECASE),
    "address": re.compile(r"\b(?:address|lives? (?:at|in)|home|ship\w*|deliver\w*|wohnt|anschrift|adresse|dirección)\b", re.IGNORECASE),
    "birth_date": re.compile(r"\b(?:born|birth\w*|dob|geboren|née?|nacid[oa])\b", re.IGNORECASE),
    "person": re.compile(r"\b(?:mr|mrs|ms|dr|prof|herr|frau|señora?|mme|monsieur|madame|name|contact|signed|regards|patient|dear)\b", re.IGNORECASE),
}
#: Kinds whose form says so little that a list or the words before must speak for a candidate.
CUED = ("person", "address", "birth_date")
#: For kinds that have no words of their own.
SENSITIVE = re.compile(r"\b(?:key|login|user|account|konto|cuenta|compte|iban|ssn|social security|passport|card|visa|tel|phone|call|mobil\w*|fax|e-?mail|mail|contact|write|aws)\b", re.IGNORECASE)
HARMLESS = re.compile(r"\b(?:version|page|chapter|isbn|issn|doi|year|figure|table|line|section|license|release\w*|updated|published|order|item|total|sum|example|sample|commit|checksum)\b", re.IGNORECASE)
# Lists that labelers look words up in.
GIVEN_NAMES = frozenset("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria peter paul hans klaus jürgen sabine monika ursula jean pierre marie sophie luc jacques josé juan carlos carmen luis ana pedro laura emma noah liam olivia ahmed fatima wei li yuki raj priya".split())
PLACES_KNOWN = frozenset("london paris berlin madrid york chicago boston houston dallas seattle munich münchen hamburg köln lyon marseille barcelona sevilla oak maple main park church mill bridge station high king queen victoria washington lincoln jefferson haupt bahnhof garten".split())
NO_NAMES = frozenset("the this that these those there then when where what which while with from into upon after before because however and but for not you they she his her its our your der die das und ein eine les des une pour dans los las una para january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday united states north south east west new".split())
PLACEHOLDERS = re.compile(r"(?:x+|\*+|\.+|<.*>|\$?\{.*\}?|changeme|example\w*|password|secret|none|null|true|false|todo|your\w*)\W*", re.IGNORECASE)
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
LABELERS = ("form", "gazetteer", "context", "harmless", "checksum", "randomness")


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    votes: tuple[int, ...]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: each @ is looked at once, with the run of characters before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    found = [(s, e, "email") for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _gazetteer(span: str, kind: str) -> int:
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", span)]
    if kind == "person":
        return -1 if NO_NAMES.intersection(words) else int(words[0] in GIVEN_NAMES)
    if kind == "address":
        return 1 if PLACES_KNOWN.intersection(words) else -1 if NO_NAMES.intersection(words) else 0
    if kind == "secret":
        return -1 if PLACEHOLDERS.fullmatch(span) else 0
    if kind == "iban":
        return 1 if span[:2] in COUNTRIES else -1
    if kind == "number":  # issuers' first digits
        return 1 if re.match(r"4|5[1-5]|3[47]|6011|65", span) else -1
    if kind == "masked_email":
        return 1 if words[-1] in ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk") else 0
    return 0


def _checksum(span: str, kind: str) -> int:
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    if kind == "iban":
        plain = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "number" and len(digits) >= 12:
        return 1 if luhn(digits) else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or len(set(digits)) < 3 else 1
    return 0


def _randomness(span: str) -> int:
    """For values of many different signs, against words and repeated signs; short ones are not judged."""
    plain = span.replace(" ", "").replace("-", "")
    if len(plain) < 10:
        return 0
    entropy = -sum(n / len(plain) * math.log2(n / len(plain)) for n in Counter(plain).values())
    if entropy < 2 or plain.isalpha():
        return -1
    return int(entropy >= 2.8)


def _votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 25]
    return (
        1 if STRICT[kind].fullmatch(span) else -1,
        _gazetteer(span, kind),
        1 if CONTEXT.get(kind, SENSITIVE).search(before) else 0,
        -1 if HARMLESS.search(before) or HARMLESS.search(after) else 0,
        _checksum(span, kind),
        0 if kind in ("person", "address", "birth_date", "masked_email") else _randomness(span),
    )


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``spans`` cover, as stretches in order that do not overlap; empty spans cover nothing."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif s < e:
            out.append((s, e))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Candidate]:
    """Spans that the wide patterns propose outside the base spans, each with its votes; of overlapping ones the first kind's stands."""
    out: list[Candidate] = []
    taken = _union([(s, e) for s, e, _ in base])
    for kind, pattern in WIDER.items():
        if kind in NEEDED and not NEEDED[kind].search(text):
            continue
        new = []
        for m in pattern.finditer(text):
            start, end = m.span(1) if pattern.groups else m.span()
            at = bisect_left(taken, (end,)) - 1  # the last taken stretch that begins before the end
            if at >= 0 and start < taken[at][1]:
                continue
            votes = _votes(text, start, end, kind)
            if kind not in CUED or 1 in votes[1:3]:
                new.append((start, end))
                out.append(Candidate(start, end, kind, votes))
        taken = _union(taken + new) if new else taken
    return out


def shape(span: str) -> str:
    """Runs of capitals, small letters and digits as one sign each."""
    return re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\dA-Z_]+", "a", re.sub(r"[0-9]+", "9", span)))[:12]


def features(text: str, c: Candidate) -> list[int]:
    """Places of the binary features of a candidate: kind with each vote, shape, length, and the words around it."""
    span = text[c.start : c.end]
    before = re.findall(r"\w+", text[max(0, c.start - 40) : c.start].lower())[-2:]
    after = re.findall(r"\w+", text[c.end : c.end + 25].lower())[:1]
    named = [f"{c.kind}", *[f"{c.kind}/{n}{v}" for n, v in zip(LABELERS, c.votes, strict=True)], *[f"{n}{v}" for n, v in zip(LABELERS, c.votes, strict=True)]]
    named += [f"shape {shape(span)}", f"{c.kind} length {min(len(span) // 4, 8)}", *[f"before {w}" for w in before], *[f"after {w}" for w in after]]
    return sorted({zlib.crc32(f.encode()) % PLACES for f in named})


Pattern = tuple[str, tuple[int, ...]]


def em(patterns: dict[Pattern, float], rounds: int = 200, lean: float = 10.0) -> tuple[dict[str, float], np.ndarray, dict[Pattern, float]]:
    """Shares of true spans by kind, reliabilities (class, labeler, vote) and posteriors of (kind, votes), with votes independent given the truth.

    A labeler has rates for each kind, which lean on its rates over all kinds as on ``lean`` more
    candidates; those over all kinds are returned.
    """
    order = sorted(patterns)
    votes, n = np.array([v for _, v in order]), np.array([patterns[p] for p in order], float)
    kinds = sorted({k for k, _ in order})
    kind = np.array([kinds.index(k) for k, _ in order])
    member = np.eye(len(kinds))[kind]  # pattern, kind
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    said, total = votes.sum(axis=1), member.T @ n
    usual = (member.T @ (n * said) / total)[kind]
    post = np.clip(0.5 + 0.1 * said + 0.1 * (said - usual), 0.05, 0.95)  # start: the majority, and what is unusual within the kind
    believed = np.array([[[2.0, 2.0, 1.0]], [[1.0, 2.0, 2.0]]])  # until counts say otherwise
    for _ in range(rounds):
        prior = (member.T @ (n * post) + 2.0) / (total + 4.0)
        weight = np.stack([n * (1 - post), n * post])
        shared = np.einsum("cp,plv->clv", weight, one) + believed
        shared /= shared.sum(axis=2, keepdims=True)
        own = np.einsum("cp,pk,plv->kclv", weight, member, one) + lean * shared
        own /= own.sum(axis=3, keepdims=True)
        like = np.einsum("plv,pclv->cp", one, np.log(own)[kind]) + np.log([1 - prior[kind], prior[kind]])
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return dict(zip(kinds, prior.tolist(), strict=True)), shared, dict(zip(order, post.tolist(), strict=True))


class Model(NamedTuple):
    """The classifier's weights, and what EM found: the share of true spans by kind, and each labeler's rates."""

    weights: np.ndarray
    shares: dict[str, float]
    rates: np.ndarray

    def accepts(self, text: str, c: Candidate) -> bool:
        return self.weights[-1] + self.weights[features(text, c)].sum() > 0


def train(rows: list[tuple[str, tuple[int, ...], list[int]]], counts: dict[Pattern, float], steps: int = 100, weights: list[float] | None = None) -> Model:
    """The span classifier, fitted to the posteriors that EM gives to the counted vote patterns of all candidates. A row counts ``weights`` times."""
    if not counts:
        return Model(np.zeros(PLACES + 1), {}, np.zeros((2, len(LABELERS), 3)))
    shares, rates, post = em(counts)
    x = np.zeros((len(rows), PLACES + 1))
    x[:, -1] = 1
    for i, (_, _, at) in enumerate(rows):
        x[i, at] = 1
    y, w, ridge = np.array([post[k, v] for k, v, _ in rows]), np.zeros(PLACES + 1), np.full(PLACES + 1, 0.1)
    m = np.ones(len(rows)) if weights is None else np.array(weights, dtype=float)
    for _ in range(steps):  # Newton steps on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (m * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(w, shares, rates)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Labelers weighed by the candidates of all documents, and the classifier trained on at most ``sample`` distinct ones.

    Equal candidates (kind, votes, features) are one row that counts as often as they occur; of more than ``sample`` distinct
    ones, they are drawn by hash in proportion to how often they occur. All together weigh as the candidates do, ``sample`` at most.
    """

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c.kind, list(c.votes), features(t, c)) for t in batch.column(0).to_pylist() if t for c in candidates(t, base_spans(t))]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32()))], names=["kind", "votes", "at"])

    found = cut(docs.select("text").mapInArrow(task, "kind string, votes array<int>, at array<int>"))
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    alike = found.groupBy("kind", "votes", "at").agg(F.count("*").alias("n"))
    first = -F.ln(uniform("kind", "votes", "at")) / F.col("n")
    few = alike.orderBy(first, "kind", "votes", "at").limit(sample).collect()
    mass = sum(r["n"] for r in few)
    share = min(sum(counts.values()), sample) / mass if mass else 0.0
    return train([(r["kind"], tuple(r["votes"]), r["at"]) for r in few], counts, weights=[r["n"] * share for r in few])


def accepted(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """Base spans and accepted candidates by start and kind."""
    more = [(c.start, c.end, c.kind) for c in candidates(text, base) if model.shares and model.accepts(text, c)]
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def find_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, end, kind) for every row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [accepted(t, b, model) for t, b in zip(texts, base, strict=True)]
            named = [[[dict(zip(("start", "end", "kind"), s, strict=True)) for s in row] for row in rows] for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, span) for x in named)], names=["doc_id", "base", "spans"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by its kind in angle brackets; null stays null."""
    schema, at = docs.schema, docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        out, floor = [], 0
        spans = accepted(t, base_spans(t), model) if t else []
        if not spans:
            return t
        for start, end, kind in spans:
            if start >= floor:
                out += [t[floor:start], f"<{kind.upper()}>"]
            floor = max(floor, end)
        return "".join([*out, t[floor:]])

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, text, pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(task, schema)
