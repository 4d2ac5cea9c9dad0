"""Personal data by weak supervision.

Base findings come from fixed patterns and always stay.  Looser candidates (spelled-out addresses, local phone
numbers, identity and account numbers, long numbers) are decided by a classifier that no labelled data is
needed for:

1. labelers vote on every candidate and base finding - patterns and checksums, gazetteers, context words - for,
   against, or not at all;
2. expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable each
   labeler is and so how likely each pattern is personal data;
3. a logistic span classifier is trained on these probabilities and the candidates' own features.

Votes and features are flags, so the corpus is summed up as counts of flag patterns: what reaches the driver is
bounded by the number of patterns, not by the corpus.  Both passes over the texts are on the map side.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import small

KINDS = ("email", "ip", "card", "phone", "spelled", "local", "ssn", "iban", "number")
BASE = 4

# The base patterns.  Lookbehinds only save starts that cannot match.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The patterns of looser candidates.
_LOOSE = (
    ("spelled", re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
        r"(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,24}){1,4}"
        r"| at [A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,3} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,24}){0,3}"
        r"| at [A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,3}\.[A-Za-z]{2,24})(?![A-Za-z0-9])"
    )),
    ("local", re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
# Every spelled-out address holds one of these.
_AT = ("(at)", "[at]", " at ")
_ANY = re.compile(r"[0-9@]")

# Gazetteers.
_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it eu ch at nl be us ca au jp cn in br ru".split())
_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
_TITLES = re.compile(r"\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|mme|señor|señora|sr|sra|name|nom|nombre)\b", re.I)
# Common given names, surnames and places; a capital tells them from ordinary words.
_GIVEN = frozenset(
    "Adam Ahmed Alex Alexander Alice Ali Amanda Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Camille Carlos "
    "Carmen Carol Caroline Catherine Charles Charlotte Chen Chiara Christian Christina Christine Christopher Claire Claudia Daniel David Deborah "
    "Diana Dmitri Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Florian Francesco Francisco Frank Gabriel George Giulia Hannah Hans "
    "Helen Henry Ivan Jack Jacob James Jan Jane Jason Javier Jean Jennifer Jessica Joan Johannes John Jonas Jonathan Jose Joseph Juan Julia "
    "Julien Karen Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Luca Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mark Markus "
    "Martin Mary Matthew Michael Michelle Miguel Mohammed Nancy Natalia Nicolas Nicole Nina Oliver Olivia Patricia Paul Pedro Peter Philip "
    "Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sergio Sofia Sophie Stefan Stephen Steven Susan Thomas Tom Ursula "
    "Victoria Walter Wei William Yuki".split()
)
_SURNAMES = frozenset(
    "Adams Ahmed Allen Anderson Bailey Baker Bauer Becker Bell Bennett Bernard Bianchi Brown Campbell Carter Clark Collins Colombo Cook Cooper "
    "Costa Cox Davis Diaz Dubois Durand Edwards Evans Ferrari Fischer Garcia Gomez Gonzalez Gray Green Gupta Hall Harris Hernandez Hill "
    "Hoffmann Howard Hughes Ivanov Jackson James Jensen Johnson Jones Kelly Khan Kim King Klein Koch Kowalski Kumar Laurent Lee Lefebvre Leroy "
    "Lewis Li Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Morgan Morris Mueller Murphy Müller Nelson Nguyen Nowak Parker Patel "
    "Peterson Phillips Popov Ramirez Reed Richter Rivera Roberts Robinson Rodriguez Romano Rossi Russo Sanchez Santos Schmidt Schneider "
    "Schulz Scott Silva Simon Singh Smirnov Smith Stewart Suzuki Tanaka Taylor Thompson Torres Turner Walker Wang Watson Weber White Williams "
    "Wilson Wolf Wright Yamamoto Yang Young Zhang".split()
)
_PLACES = frozenset(
    "Amsterdam Athens Atlanta Austin Bangkok Barcelona Basel Beijing Belgrade Berlin Bern Birmingham Bordeaux Boston Bremen Brisbane Bristol "
    "Brussels Bucharest Budapest Cairo Chicago Cologne Copenhagen Dallas Delhi Denver Dresden Dublin Dubai Edinburgh Florence Frankfurt Geneva "
    "Genoa Glasgow Hamburg Hannover Helsinki Houston Istanbul Jakarta Johannesburg Kyoto Lagos Leeds Leipzig Lille Lima Lisbon Liverpool "
    "London Lyon Madrid Manchester Marseille Melbourne Miami Milan Montreal Moscow Mumbai Munich Nairobi Nantes Naples Oslo Osaka Ottawa Paris "
    "Perth Philadelphia Phoenix Porto Prague Riga Rome Rotterdam Salzburg Santiago Seattle Seoul Seville Shanghai Singapore Sofia Stockholm "
    "Strasbourg Stuttgart Sydney Tallinn Tokyo Toronto Toulouse Turin Utrecht Valencia Vancouver Venice Vienna Vilnius Warsaw Zagreb Zurich".split()
)
_GAZETTEER = _GIVEN | _SURNAMES | _PLACES
_WORD = re.compile(r"[^\W\d_]+")
# Context words for and against.
_FOR = re.compile(
    r"\b(?:e-?mail|mail|contact|kontakt|contacto|tel|telephone|phone|fon|telefon|téléphone|teléfono|call|mobile|handy|fax|card|karte|carte|"
    r"tarjeta|visa|mastercard|amex|credit|ssn|social security|iban|account|konto|compte|cuenta|ip|address|adresse|dirección)\b",
    re.I,
)
_AGAINST = re.compile(
    r"\b(?:order|invoice|isbn|issn|doi|version|license|licence|serial|item|sku|part|ticket|tracking|reference|ref|hash|token|commit|build|"
    r"article|page|volume|figure|table|section)\b",
    re.I,
)
_BEFORE = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # the part before an @ is the whole run of its characters, so nothing is scanned twice
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and looser candidates as (start, kind, end), code points, end exclusive, in order."""
    base: list[tuple[int, int, int]] = []
    loose: list[tuple[int, int, int]] = []
    has_at = any(mark in text for mark in _AT)
    if not has_at and not _ANY.search(text):
        return base, loose
    if "@" in text:
        base += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            base.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(number := _digits(m[0])) <= 19:
            if luhn(number):
                base.append((m.start(), 2, m.end()))
            else:
                loose.append((m.start(), KINDS.index("number"), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                base.append((m.start(), 3, m.end()))
    for kind, pattern in _LOOSE:
        if kind != "spelled" or has_at:
            loose += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    base.sort()
    taken, kept = sorted((a, b) for a, _, b in base), []
    at, reach = 0, -1
    for start, kind, end in sorted(loose):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if start >= reach:
            kept.append((start, kind, end))
            reach = end  # of overlapping candidates the first stays
    return base, kept


LABELERS = ("form", "checksum", "domain or country", "name near", "word for", "word against", "inside a token", "monotone")
VOTES = 3 ** len(LABELERS)
FLAGS = ("checksum", "no checksum", "separated", "word for", "word against", "inside a token", "monotone", "known domain", "name near")


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """Votes (base 3: 0 abstains, 1 for, 2 against) and feature flags (bits) of a span."""
    span, name = text[start:end], KINDS[kind]
    before, around = text[max(0, start - _BEFORE) : start], text[max(0, start - 1) : start] + text[end : end + 1]
    number = _digits(span)
    check = None
    if name in ("card", "number"):
        check = luhn(number)
    elif name == "iban":
        check = _mod97(span)
    elif name == "ssn":
        check = number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"
    known = None
    if name in ("email", "spelled"):
        known = re.split(r"[^A-Za-z]+", span)[-1].lower() in _DOMAINS
    elif name == "iban":
        known = span[:2] in _COUNTRIES
    inside = any(c.isalnum() or c in "_=/" for c in around)
    monotone = len(set(number)) <= 2 and len(number) >= 7
    good, bad = bool(_FOR.search(before)), bool(_AGAINST.search(before))
    near = bool(_TITLES.search(before)) or not _GAZETTEER.isdisjoint(_WORD.findall(before))
    strict = kind < BASE or name in ("ssn", "iban")
    yes_no = lambda x: 0 if x is None else 1 if x else 2
    votes = (int(strict), yes_no(check), yes_no(known), int(near), int(good), 2 * bad, 2 * inside, 2 * monotone)
    flags = (check is True, check is False, any(c in " -.()" for c in span), good, bad, inside, monotone, bool(known), near)
    return sum(v * 3**i for i, v in enumerate(votes)), sum(f << i for i, f in enumerate(flags))


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (P(vote | class) of each labeler, P(personal) of each pattern)."""
    cast = np.stack([votes // 3**i % 3 for i in range(len(LABELERS))], axis=1)
    # the start: a vote is right four times in five
    p = np.full((len(LABELERS), 2, 3), 0.0)
    p[:, 1], p[:, 0] = (0.6, 0.32, 0.08), (0.6, 0.08, 0.32)
    prior = np.full(len(KINDS), 0.5)
    belief = np.full(len(counts), 0.5)
    for _ in range(rounds):
        score = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for i in range(len(LABELERS)):
            given = np.log(p[i, 1, cast[:, i]]) - np.log(p[i, 0, cast[:, i]])
            score += np.where(cast[:, i] > 0, given, 0.0)  # an abstention says nothing
        belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        for kind in range(len(KINDS)):
            mine = kinds == kind
            prior[kind] = (counts[mine] @ belief[mine] + 2) / (counts[mine].sum() + 4)
        for i in range(len(LABELERS)):
            for c, weight in ((1, counts * belief), (0, counts * (1 - belief))):
                votes_of = np.array([weight[cast[:, i] == v].sum() for v in range(3)])
                said = votes_of[1:] + 8 * np.array([0.8, 0.2] if c else [0.2, 0.8])
                p[i, c] = np.r_[0.5, 0.5 * said / said.sum()]
    return p, belief


def train(kinds: np.ndarray, flags: np.ndarray, belief: np.ndarray, counts: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of a logistic span classifier on kind and flags, by weighted gradient steps on soft labels."""
    x, w = _inputs(kinds, flags), np.zeros(len(KINDS) + len(FLAGS) + 1)
    weight = np.sqrt(counts)  # frequent patterns count more, but do not drown the rest
    weight = weight / max(1.0, weight.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (weight * (p - belief)) + 1e-4 * w)
    return w


def _inputs(kinds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    bits = np.stack([flags >> i & 1 for i in range(len(FLAGS))], axis=1) if len(flags) else np.zeros((0, len(FLAGS)))
    return np.hstack([np.eye(len(KINDS))[kinds], bits, np.ones((len(kinds), 1))])


def patterns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, flags, n): counts of the flag patterns of all findings in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                for spans in findings(text or ""):
                    seen.update((kind, *describe(text, start, kind, end)) for start, kind, end in spans)
        columns = [[key[i] for key in seen] for i in range(3)] + [list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "votes", "flags", "n"])

    texts = df.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(run, "kind long, votes long, flags long, n long")
    return counted.groupBy("kind", "votes", "flags").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text_col: str = "text") -> frozenset[tuple[int, int]]:
    """The (kind, flags) of looser candidates that the trained classifier takes for personal data."""
    seen = patterns(df, text_col).orderBy("kind", "votes", "flags").toPandas()
    kinds, votes, flags, counts = (seen[c].to_numpy(dtype=np.int64) for c in ("kind", "votes", "flags", "n"))
    if not len(seen):
        return frozenset()
    _, belief = reliabilities(kinds, votes, counts.astype(float))
    weights = train(kinds, flags, belief, counts.astype(float))
    taken = _inputs(kinds, flags) @ weights > 0
    return frozenset((int(k), int(f)) for k, f, t in zip(kinds, flags, taken, strict=True) if t and k >= BASE)


def spans(text: str, taken: frozenset[tuple[int, int]]) -> tuple[list, list]:
    """Base spans, and all spans: with the candidates the classifier takes."""
    base, loose = findings(text)
    more = [(a, k, b) for a, k, b in loose if (k, describe(text, a, k, b)[1]) in taken]
    return base, sorted(base + more)


def listing(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    A null text counts as empty, without findings; rows may repeat; an empty table gives no rows; other columns
    are not read.
    """
    taken = learn(df, text_col)
    counts = [f"n_{k}" for k in KINDS[:BASE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [spans(t or "", taken) for t in batch.column(1).to_pylist()]
            numbers = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(BASE)]
            digests = [hashlib.sha256(listing(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array([listing(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_sha256", "spans"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union, named by the first."""
    parts, at = [], 0
    for start, kind, end in found:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in its text replaced by the kind in brackets; null texts stay null."""
    taken = learn(df, text_col)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t if t is None else masked(t, spans(t, taken)[1]) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
